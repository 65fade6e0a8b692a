"""Data-quality analytics on Spark DataFrames."""
