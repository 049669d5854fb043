"""Operators over facts, changes and findings: DataFrames in, a DataFrame out."""
