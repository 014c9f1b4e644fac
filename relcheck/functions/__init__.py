"""Pure functions as column expressions. Where a function has no value, the column is null."""
