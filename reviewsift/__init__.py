"""Review-anomaly analytics on Spark DataFrames."""
