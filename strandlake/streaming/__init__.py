"""Structured Streaming forms of the mapping plans."""
