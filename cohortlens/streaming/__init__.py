"""Structured Streaming forms of the row-local and keyed operators."""
