"""Gridloom: sparse matrices, sparse tensors and graphs as Spark DataFrames."""

__version__ = "0.1.0"
