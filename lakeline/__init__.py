"""Document-retrieval analytics and table operators on Spark DataFrames."""
