"""Long-read transcript analytics as Spark DataFrame jobs."""
