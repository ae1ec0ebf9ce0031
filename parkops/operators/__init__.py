"""Operators: plain functions from DataFrames to DataFrames (reports, boards,
ranking, quality, table operations and the batch transforms)."""
