"""Document-zone analytics on Spark."""
