"""Relational operators: each maps DataFrames to a DataFrame."""
