"""Document-to-panel analytics as Spark DataFrame jobs."""
