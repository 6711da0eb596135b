"""Column functions: every one builds a native Spark expression, none is a Python UDF."""
