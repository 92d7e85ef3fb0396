"""Session-aligned market analytics on Spark DataFrames."""
