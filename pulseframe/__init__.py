"""Personal-health analytics expressed as Spark DataFrame jobs."""
