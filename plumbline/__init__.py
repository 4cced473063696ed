"""plumbline: set-oriented retrieval, grounding and evaluation on Spark DataFrames."""
