"""Structured Streaming forms of the line search."""
