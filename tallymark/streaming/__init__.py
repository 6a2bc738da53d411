"""Incremental sketches with Structured Streaming."""
