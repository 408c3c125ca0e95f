"""Structured Streaming versions of the chronological operators."""
