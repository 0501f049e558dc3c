"""Species observations around points of interest, as Spark DataFrame jobs."""
