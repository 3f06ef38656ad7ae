"""Similarity search over fixed-length numeric series, and more, as Spark plans."""
