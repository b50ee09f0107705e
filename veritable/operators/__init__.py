"""Operators: each takes a Dataset and returns a DataFrame."""
