"""Account-state analytics on Spark."""
