"""Graphs, sparse matrices and multilevel solvers as DataFrames."""
