"""Evidence retrieval and ranking analytics on Spark DataFrames."""
