"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it, so the relational engine works
without it.  Every operator reads whole tables and whole texts, takes any
DataFrame that has the named columns (other columns are ignored or carried
through) and states in its docstring what it does with nulls, empty texts,
ties and empty tables.
"""
