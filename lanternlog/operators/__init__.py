"""Operators over documents: parse, views, feeds, aggregates, enrichment, detection."""
