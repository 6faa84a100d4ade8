"""functions: column expressions (no DataFrames, no actions)."""
