"""Corpus and embedding-space analytics on Spark DataFrames."""
