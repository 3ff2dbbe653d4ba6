"""Operators on graphs, state and memories: DataFrames in, DataFrames out, for all queries at once."""
