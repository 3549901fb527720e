"""Operators on listing tables: DataFrames in, DataFrames out; time is always an argument."""
