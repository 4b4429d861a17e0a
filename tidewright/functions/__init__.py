"""Column-level functions: they build Spark expressions and never touch data."""
