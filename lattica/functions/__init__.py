"""Lowering of bound expressions to Columns."""
