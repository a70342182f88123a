"""Document, key-value and vector analytics on Spark DataFrames."""
