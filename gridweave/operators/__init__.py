"""Operators on graphs, matrices and vectors; all are lazy functions from DataFrames to DataFrames."""
