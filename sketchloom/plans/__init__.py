"""Whole comparisons composed of several operators."""
