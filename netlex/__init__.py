"""Network and transcript analytics on Spark DataFrames."""
