"""Operators: DataFrames and parameters to a DataFrame, lazily."""
