"""Media-catalog analytics as Spark DataFrame jobs."""
