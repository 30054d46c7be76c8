"""Proof-history analytics on Spark DataFrames."""
