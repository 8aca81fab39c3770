"""Composite analyses: DataFrames in, DataFrame or dict of DataFrames out."""
