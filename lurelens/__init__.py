"""lurelens: email-threat analytics expressed as Spark DataFrame jobs."""
