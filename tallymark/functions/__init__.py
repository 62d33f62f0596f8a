"""Column -> Column functions; all built from native Spark expressions."""
