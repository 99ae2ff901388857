"""Lint operators: each takes and returns DataFrames."""
