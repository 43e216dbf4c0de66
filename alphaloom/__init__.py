"""alphaloom: systematic-signal research and validation as Spark DataFrame jobs."""
