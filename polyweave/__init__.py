"""Parallel-corpus and training-data operators on Spark DataFrames."""
