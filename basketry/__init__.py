"""Price and basket analytics on Spark."""
