"""Shop-floor quality analytics on Spark DataFrames."""
