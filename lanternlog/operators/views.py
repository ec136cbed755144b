"""Named virtual views: unions of tables with a filter per source, expanded at read time."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.predicates import compile_filter, validate_filter, where
from lanternlog.model import ALERT_VIEW_FILTER, TS

DETECTIONS = "detections"
RESERVED = {
    "soc-alerts": [("suricata-*", ALERT_VIEW_FILTER), (DETECTIONS, None), (f"{DETECTIONS}-*", None)],
    "suricata": [("suricata-*", None)],
    "sigma-alerts": [(DETECTIONS, None), (f"{DETECTIONS}-*", None)],
}
# What names of views and sources may look like, and the day at the end of a table's name.
_NAME = r"[A-Za-z0-9][A-Za-z0-9._+-]*"
_SOURCE = r"[A-Za-z0-9][A-Za-z0-9._+*-]*"
_DAY = r"\d{4}\.\d{2}\.\d{2}"

Filter = dict[str, Any] | None


@dataclass
class Dataset:
    """A registered table set: ``frame`` reads it; ``tables`` lists its physical table names.

    A dated set has one physical table per day, ``<base>-YYYY.MM.DD``, kept in one
    parquet dataset partitioned by ``_day``.
    """

    base: str
    frame: Callable[[], DataFrame]
    tables: Callable[[], Sequence[str]]


@dataclass
class Catalog:
    """Datasets and view definitions. Definitions are metadata; reads expand them anew."""

    datasets: dict[str, Dataset] = field(default_factory=dict)
    views: dict[str, list[tuple[str, Filter]]] = field(default_factory=dict)
    #: Called with all definitions whenever one changes.
    saved: Callable[[dict[str, list[tuple[str, Filter]]]], None] | None = None

    def register(self, base: str, frame: Callable[[], DataFrame], tables: Callable[[], Sequence[str]]) -> None:
        self.datasets[base] = Dataset(base, frame, tables)

    # names ---------------------------------------------------------------------------

    def table_names(self) -> dict[str, str]:
        """Physical table name -> dataset base."""
        return {t: d.base for d in self.datasets.values() for t in d.tables()}

    def resolve(self, source: str) -> list[str]:
        """Tables a concrete name or pattern stands for now."""
        names = self.table_names()
        if "*" not in source:
            return [source] if source in names else []
        return sorted(n for n in names if fnmatch.fnmatchcase(n, source))

    def check_view_name(self, name: str) -> None:
        if not name:
            raise ValueError("view name is required")
        if name == "_all" or name.startswith(".") or not re.fullmatch(_NAME, name):
            raise ValueError(f"unsafe view name {name!r}")
        if name in RESERVED:
            raise ValueError(f"view {name!r} is reserved")
        if name in self.table_names():
            raise ValueError(f"{name!r} is a physical table")

    # definitions ------------------------------------------------------------------------

    def create_view(self, name: str, sources: Iterable[tuple[str, Filter]]) -> dict[str, Any]:
        """Add sources to a view. Checks everything first, then swaps the definition in."""
        self.check_view_name(name)
        wanted = dict(self._sources(sources))
        reached = {source: self.resolve(source) for source in wanted}
        missing = [s for s, tables in reached.items() if not tables and "*" not in s]
        if missing:
            raise ValueError(f"no table behind {missing[0]!r}")
        for source, query in wanted.items():
            if query is not None:
                validate_filter(self._probe(reached[source]), query)
        # a table may be reached by several sources only under one filter
        filters: dict[str, dict[str, Filter]] = {}
        for source, tables in reached.items():
            for table in tables:
                filters.setdefault(table, {})[repr(wanted[source])] = wanted[source]
        torn = sorted(table for table, own in filters.items() if len(own) > 1)
        if torn:
            raise ValueError(f"table {torn[0]!r} would be under different filters")
        # Additive; a source named again takes its new filter.
        self._define({**self.views, name: list((dict(self.views.get(name, ())) | wanted).items())})
        return {"view": name, "tables": sorted(filters), "patterns": [s for s in wanted if "*" in s]}

    @staticmethod
    def _sources(given: Iterable[tuple[str, Filter]]) -> list[tuple[str, Filter]]:
        """The sources as pairs with safe names; one named twice must have one filter."""
        pairs = list(given)
        if not pairs:
            raise ValueError("a view needs a source")
        seen: dict[str, Filter] = {}
        for source, query in pairs:
            if source == "_all" or not re.fullmatch(_SOURCE, source or ""):
                raise ValueError(f"unsafe source {source!r}")
            if seen.setdefault(source, query) != query:
                raise ValueError(f"source {source!r} comes with different filters")
        return pairs

    def _define(self, views: dict[str, list[tuple[str, Filter]]]) -> None:
        if self.saved:
            self.saved(views)
        self.views = views

    def delete_view(self, name: str) -> dict[str, Any]:
        """Drop the definition; tables and documents stay."""
        self.check_view_name(name)
        removed = self.views.get(name, [])
        self._define({k: v for k, v in self.views.items() if k != name})
        return {"view": name, "removed": [s for s, _ in removed]}

    def list_views(self, show_all: bool = False, include_reserved: bool = False) -> list[str]:
        names = [*self.views, *(RESERVED if include_reserved else ())]
        return sorted(n for n in names if show_all or not n.startswith("."))

    def _definition(self, name: str) -> list[tuple[str, Filter]]:
        if name in RESERVED:
            return RESERVED[name]
        if name in self.views:
            return self.views[name]
        return [(name, None)]

    def _probe(self, tables: Sequence[str]) -> DataFrame:
        bases = self.table_names()
        base = bases[tables[0]] if tables else next(iter(self.datasets), None)
        if base is None:
            raise ValueError("no table to analyse the filter against")
        return self.datasets[base].frame()

    # reads -------------------------------------------------------------------------------

    def table_filters(self, name: str) -> dict[str, Filter]:
        """Table -> filter for a view, a pattern or a table. Later sources win."""
        out: dict[str, Filter] = {}
        for source, query in self._definition(name):
            for table in self.resolve(source):
                out[table] = query
        return out

    def read(self, name: str, now: Any = None) -> DataFrame:
        """Union of the sources, each under its filter.

        Tables of one dataset that share a filter are one scan, restricted to their days
        so the partition pruning is by value; a whole dataset gets no restriction at all.
        """
        filters = self.table_filters(name)
        bases = self.table_names()
        parts: list[DataFrame] = []
        for base, dataset in self.datasets.items():
            mine = {t: q for t, q in filters.items() if bases[t] == base}
            groups: dict[str, tuple[Filter, list[str]]] = {}
            for table, query in mine.items():
                groups.setdefault(repr(query), (query, []))[1].append(table)
            for query, tables in groups.values():
                frame = dataset.frame()
                if set(tables) != set(dataset.tables()):
                    frame = frame.where(_tables_test(frame, base, tables))
                parts.append(where(frame, query, now))
        if not parts:
            return self._empty(name)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def _empty(self, name: str) -> DataFrame:
        if "*" not in name and not any("*" in s for s, _ in self._definition(name)) and name not in RESERVED:
            raise ValueError(f"no table or view {name!r}")
        if not self.datasets:
            raise ValueError("catalog has no dataset")
        return next(iter(self.datasets.values())).frame().where(F.lit(False))


def _tables_test(frame: DataFrame, base: str, tables: Sequence[str]) -> Column:
    days = [t[len(base) + 1 :] for t in tables]
    if "_day" in frame.columns and all(re.fullmatch(_DAY, d) for d in days):
        return F.col("_day").isin([F.lit(d.replace(".", "-")).cast("date") for d in days])
    return F.col("_index").isin(list(tables))


def coverage(df: DataFrame, views: dict[str, dict[str, Filter]], now: Any = None) -> DataFrame:
    """Documents and first/last event per (view, table), for many views in one scan.

    ``views`` maps a view to its sources (pattern -> filter). The first pattern that
    covers a table decides. Patterns without a table come out with null table.
    """
    members, declared = [], []
    for view, sources in views.items():
        chain = None
        for pattern, query in sources.items():
            test = F.col("_index").rlike(_glob_regex(pattern))
            inside = F.coalesce(compile_filter(df, query, now), F.lit(False))
            value = F.when(inside, F.struct(F.lit(view).alias("view"), F.lit(pattern).alias("pattern")))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
            declared.append((view, pattern))
        members.append(chain)
    hits = df.withColumn("_m", F.explode(F.filter(F.array(*members), lambda m: m.isNotNull())))
    found = hits.groupBy(F.col("_m.view").alias("view"), F.col("_m.pattern").alias("pattern"), "_index").agg(
        F.count(F.lit(1)).alias("docs"), F.min(TS).alias("first_event"), F.max(TS).alias("last_event")
    )
    spec = df.sparkSession.createDataFrame(declared, "view string, pattern string")
    return (
        spec.join(found, ["view", "pattern"], "full_outer")
        .withColumn("has_wildcard", F.col("pattern").contains("*"))
        .withColumn("future_only", F.col("_index").isNull() & F.col("has_wildcard"))
    )


def _glob_regex(pattern: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
