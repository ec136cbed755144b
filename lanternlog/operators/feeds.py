"""Feeds: filtered, newest first, one top-k each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from lanternlog.functions.predicates import all_of, severity_filter, where
from lanternlog.functions.projections import select_fields
from lanternlog.model import ALERT_FIELDS, FLOW_FIELDS, TS

MAX_PAGE = 500


def _page(df: DataFrame, size: int, offset: int) -> DataFrame:
    """Ties of the event time are broken by table and id, so pages never overlap."""
    ordered = df.orderBy(F.col(TS).desc(), F.col("_index"), F.col("_id"))
    return (ordered.offset(offset) if offset else ordered).limit(size)


def _check(size: int, offset: int = 0) -> None:
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"size must be 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def alert_filter(severity: str = "", q: str = "", dataset: str = "") -> dict[str, Any]:
    """Free text needs every word; an unknown severity name filters nothing."""
    return all_of(
        {"search": {"query": q, "operator": "and"}} if q else None,
        {"term": {"event.dataset": dataset}} if dataset else None,
        severity_filter(severity),
    )


def alert_feed(
    alerts: DataFrame, size: int = 100, severity: str = "", q: str = "", dataset: str = "", offset: int = 0
) -> DataFrame:
    _check(size, offset)
    page = _page(where(alerts, alert_filter(severity, q, dataset)), size, offset)
    return select_fields(page, ["_index", "_id", *ALERT_FIELDS])


def flow_filter(q: str = "", proto: str = "") -> dict[str, Any]:
    """Free text needs any word."""
    return all_of(
        {"term": {"event.dataset": "suricata.flow"}},
        {"search": {"query": q, "operator": "or"}} if q else None,
        {"term": {"network.transport": proto.lower()}} if proto else None,
    )


def flow_feed(docs: DataFrame, size: int = 100, q: str = "", proto: str = "") -> DataFrame:
    _check(size)
    page = _page(where(docs, flow_filter(q, proto)), size, 0)
    return select_fields(page, ["_index", "_id", *FLOW_FIELDS])


def total(df: DataFrame, query: dict[str, Any] | None = None) -> DataFrame:
    """Exact number of matches, one row."""
    return where(df, query).agg(F.count(F.lit(1)).alias("total"))


def search(
    df: DataFrame,
    query: dict[str, Any] | None = None,
    size: int = 100,
    sort: list[dict[str, Any]] | None = None,
    now: Any = None,
) -> DataFrame:
    """First ``size`` matches in the given order (``[{path: "asc"|"desc"}]``)."""
    from lanternlog.functions.predicates import Fields

    out, fields = where(df, query, now), Fields(df.schema)
    if sort:
        keys = []
        for item in sort:
            path, spec = next(iter(item.items()))
            order = spec["order"] if isinstance(spec, dict) else spec
            column = fields.column(path)
            # a dynamic path may hold numbers: these sort by value, before or after all text
            for key in [column.try_cast("double"), column] if fields.promoted(path) is None else [column]:
                keys.append(key.desc_nulls_last() if order == "desc" else key.asc_nulls_last())
        out = out.orderBy(*keys, "_index", "_id")
    return out.limit(size)


def scan(df: DataFrame, query: dict[str, Any] | None = None, now: Any = None) -> DataFrame:
    """All matches. Stays lazy; iterate with ``toLocalIterator`` only at the edge."""
    return where(df, query, now)


def get(df: DataFrame, index: str, doc_id: str) -> DataFrame:
    """The document, one row; ``LookupError`` when there is none."""
    row = df.where((F.col("_index") == index) & (F.col("_id") == doc_id))
    if row.isEmpty():
        raise LookupError(f"{index}/{doc_id}")
    return row


def exists(df: DataFrame, index: str, doc_id: str) -> bool:
    return not df.where((F.col("_index") == index) & (F.col("_id") == doc_id)).isEmpty()


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """Last ``n`` lines per file: a per-partition top-k, then one of at most n rows per input task."""
    order = W.partitionBy("file").orderBy(F.col("line_no").desc())
    ranked = lines.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= n)
    return ranked.select("file", "from_end", "line")
