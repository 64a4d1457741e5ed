"""Analytic operators: DataFrames in, DataFrames out."""
