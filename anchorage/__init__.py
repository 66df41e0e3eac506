"""Subject-anchored event analytics on Spark DataFrames."""
