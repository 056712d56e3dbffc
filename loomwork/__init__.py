"""Work-artifact analytics as Spark DataFrame, SQL and streaming jobs."""
