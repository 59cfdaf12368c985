"""Private aggregation of measurement reports as ordinary Spark jobs."""
