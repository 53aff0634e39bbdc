"""Operators on DataFrames: key sets and text retrieval."""
