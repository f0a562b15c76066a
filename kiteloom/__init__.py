"""Kiteloom: parallel-corpus preparation, auditing and evaluation on Spark DataFrames."""
