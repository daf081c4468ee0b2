"""Operators of the library: DataFrames in, DataFrames out."""
