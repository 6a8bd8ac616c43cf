"""recollect: analytics over record stores, as Spark DataFrame operations."""
