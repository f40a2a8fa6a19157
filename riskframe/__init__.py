"""Consumer-credit risk analytics as Spark DataFrame jobs."""
