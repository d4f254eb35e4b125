"""Where objects come from and where they are kept."""
