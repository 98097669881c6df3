"""Repository intelligence and evidence retrieval on Spark DataFrames."""
