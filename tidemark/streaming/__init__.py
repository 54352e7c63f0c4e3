"""Structured Streaming versions of the polled jobs."""
