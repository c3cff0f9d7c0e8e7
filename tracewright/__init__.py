"""Security-evidence analytics as Spark jobs."""
