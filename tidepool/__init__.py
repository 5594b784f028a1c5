"""Table discovery and corpus processing on Spark."""
