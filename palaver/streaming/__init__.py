"""Structured Streaming forms of the load and of the hourly counts."""
