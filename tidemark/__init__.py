"""Event-stream operations analytics on Spark DataFrames."""
