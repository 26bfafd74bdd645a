"""Structured Streaming over the traces of running searches."""
