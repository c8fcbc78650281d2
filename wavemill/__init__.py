"""Feed catalogues, search logs, clip requests and sessions as Spark DataFrame jobs."""
