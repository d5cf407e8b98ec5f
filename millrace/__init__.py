"""Document analytics, retrieval and evaluation on Spark DataFrames."""
