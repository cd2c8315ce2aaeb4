"""Document-policy analytics on Spark."""
