"""stepweave: vertex programs, ranking and clustering as DataFrame supersteps on Spark."""
