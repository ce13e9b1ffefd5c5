"""Point-in-time market-event analytics on Spark."""
