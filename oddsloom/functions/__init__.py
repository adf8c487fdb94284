"""Column builders: every function takes and returns Spark Columns."""
