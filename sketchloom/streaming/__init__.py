"""Sketches of streams: incremental aggregation by Structured Streaming."""
