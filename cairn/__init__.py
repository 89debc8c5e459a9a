"""Code-graph analytics on Spark."""
