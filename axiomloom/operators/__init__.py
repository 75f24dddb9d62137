"""Operators over ontology tables: DataFrames in, DataFrames out."""
