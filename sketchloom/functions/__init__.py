"""Scalar building blocks: sequences, k-mers and hash functions."""
