"""Structured Streaming ingest (an extension)."""
