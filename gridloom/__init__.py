"""Sparse graph analytics on Spark DataFrames."""
