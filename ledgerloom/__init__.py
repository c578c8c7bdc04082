"""Business performance analytics as PySpark DataFrame jobs."""
