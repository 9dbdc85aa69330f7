"""Trial-vector analytics on Spark DataFrames."""
