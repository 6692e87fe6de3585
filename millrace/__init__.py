"""Analytics operators written as ordinary Spark DataFrame and Structured Streaming jobs."""
