"""The registered queries: each reads the given tables and has an SQL oracle where SQL can say it."""

from lanternlog.plans import alerts, catalog, detection, enrichment, filters, ingest, stores, text
from lanternlog.plans.registry import QUERIES

__all__ = ["QUERIES", "alerts", "catalog", "detection", "enrichment", "filters", "ingest", "stores", "text"]
