"""Document and reader analytics on Spark."""
