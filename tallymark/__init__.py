"""Model-evaluation analytics on Spark: score recorded answers, verify chained arithmetic, build metric tables."""
