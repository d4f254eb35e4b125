"""Spark-native analytics over content-addressed, append-only object stores."""
