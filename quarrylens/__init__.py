"""Code-history and text analytics on Spark DataFrames."""
