"""Structured Streaming forms of mergeable metrics."""
