"""Process-engineering analytics on Spark DataFrames."""
