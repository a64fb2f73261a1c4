"""Structured Streaming jobs that keep an index current."""
