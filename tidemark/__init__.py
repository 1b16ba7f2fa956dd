"""tidemark: analytics building blocks on Spark DataFrames."""
