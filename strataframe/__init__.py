"""Layer analytics on Spark."""
