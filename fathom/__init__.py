"""Document and knowledge-base analytics on Spark DataFrames."""
