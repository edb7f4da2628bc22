"""Retrieval, evaluation and training-data analytics on Spark DataFrames."""
