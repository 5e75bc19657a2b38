"""Sequence files as DataFrames, and text forms of results."""
