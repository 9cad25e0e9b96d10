"""Structured Streaming: incremental ingest, duplicates, progress and sessions."""
