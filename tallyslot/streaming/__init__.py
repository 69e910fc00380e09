"""Streaming twins of the write-side jobs."""
