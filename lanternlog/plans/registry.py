"""Name -> (query, oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.model import TS
from lanternlog.sources.bind import DOCS_SQL, Tables

Plan = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, docs: bool = True) -> Callable[[Plan], Plan]:
    """Register a plan. ``docs`` prefixes the oracle with the document mapping."""

    def add(plan: Plan) -> Plan:
        sql = oracle
        if sql is not None and docs:
            body = sql.strip()
            sql = f"WITH {DOCS_SQL.strip()}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(name, plan, sql)
        return plan

    return add


def millis(column: str | Column = TS) -> Column:
    return F.unix_millis(column).alias("ts_ms")
