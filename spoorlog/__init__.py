"""Security-log analytics as Spark DataFrame jobs."""
