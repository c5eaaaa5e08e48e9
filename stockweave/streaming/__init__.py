"""Incremental updates through Structured Streaming."""
