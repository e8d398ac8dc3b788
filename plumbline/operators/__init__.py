"""Operators: DataFrames and settings in, a lazy DataFrame out. Only loops trigger jobs."""
