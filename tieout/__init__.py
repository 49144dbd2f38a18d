"""Statement tie-out analytics over whole portfolios, expressed as Spark DataFrame jobs."""
