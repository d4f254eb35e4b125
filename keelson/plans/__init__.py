"""From expressions and constraints to DataFrames."""
