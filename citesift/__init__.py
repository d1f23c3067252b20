"""citesift: evidence retrieval, ranking and citation checks as Spark DataFrame jobs."""
