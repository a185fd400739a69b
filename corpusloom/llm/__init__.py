"""Operators for large training-data pipelines: each takes and returns DataFrames."""
