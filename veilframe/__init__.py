"""Personal-data span analytics on Spark DataFrames."""
