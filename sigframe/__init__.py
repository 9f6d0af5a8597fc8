"""Signal-vector analytics as Spark DataFrame jobs."""
