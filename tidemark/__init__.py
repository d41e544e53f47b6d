"""Causal multi-scale pattern analytics over price series, on Spark DataFrames."""
