"""Cohort operators: DataFrames in, DataFrames out."""
