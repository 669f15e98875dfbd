"""quarry: retrieval, memory-lifecycle and corpus analytics on Spark DataFrames."""
