"""Multi-dimensional arrays as Spark DataFrames."""
