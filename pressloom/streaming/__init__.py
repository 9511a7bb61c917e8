"""Structured Streaming forms of the append-only jobs."""
