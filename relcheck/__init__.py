"""A PySpark engine for declaring, loading, validating and querying typed reference tables."""
