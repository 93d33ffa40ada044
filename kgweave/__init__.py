"""Property-graph retrieval and evaluation analytics on Spark."""
