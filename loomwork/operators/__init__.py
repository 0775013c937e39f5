"""Operators: DataFrames to DataFrames, without actions unless a docstring says so."""
