"""Sketching and comparison of large sequence collections, expressed on Spark DataFrames."""

__version__ = "0.1.0"
