"""Sketch aggregations and the measures between sketches."""
