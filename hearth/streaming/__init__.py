"""Structured Streaming forms of ingest and of event counts."""
