"""Event-archive analytics and retrieval on Spark."""
