"""Contact-log analytics, bulk enrichment and ETL expressed as Spark jobs."""
