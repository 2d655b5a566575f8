"""Pattern-constrained vector search on Spark."""
