"""Repository and corpus analytics on Spark DataFrames."""
