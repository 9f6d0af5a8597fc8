"""Structured Streaming forms of the bucket and clip operators."""
