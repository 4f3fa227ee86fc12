"""Lowering of bound relations to DataFrames."""
