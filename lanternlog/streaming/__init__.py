"""Structured Streaming twins of ingest and detection."""
