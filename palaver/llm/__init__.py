"""Operators of a training-data pipeline: quality, language, tokens, leaks, copies, secrets, packing."""
