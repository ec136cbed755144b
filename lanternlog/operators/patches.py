"""Audited field patches and the documents they produce (merge on read).

A patch record is one row per (operation, document): what the fields were and what
they became. Records are ordered by (``run_seq``, ``op_seq``). The current state of a
document is its stored leaves plus, per path, the last operation that touches it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fields as leafs
from lanternlog.functions.predicates import where
from lanternlog.model import PROMOTED, TS, column_of

PATCH_COLUMNS = [
    "run_id",
    "run_seq",
    "op_seq",
    TS,
    "enrichment",
    "cluster",
    "index",
    "doc_id",
    "doc_day",
    "operation",
    "changed_fields",
    "rollback_supported",
    "before",
    "after",
    "reverts_run_id",
]

#: Age of a stored row: the write that made it, in the order of records. Records older than a row are not about it.
BORN = "_born"

_STATE = "struct<exists:boolean,value:string>"
_BEFORE = f"map<string,{_STATE}>"
_PATH = re.compile(r"[^.]+(\.[^.]+)*")


@dataclass(frozen=True)
class Run:
    """Identity of a run, stamped on its records."""

    run_id: str
    enrichment: str
    cluster: str = "lab"
    run_seq: int = 1
    time: Any = None  # datetime or column; the query's start time by default

    def stamp(self, op_seq: int) -> dict[str, Column]:
        time = F.current_timestamp() if self.time is None else self.time
        return {
            "run_id": F.lit(self.run_id),
            "run_seq": F.lit(self.run_seq).cast("bigint"),
            "op_seq": F.lit(op_seq).cast("bigint"),
            TS: time if isinstance(time, Column) else F.lit(time),
            "enrichment": F.lit(self.enrichment),
            "cluster": F.lit(self.cluster),
            "reverts_run_id": F.lit(None).cast("string"),
        }


def born(ticket: Column, op: Column) -> Column:
    return F.struct(ticket.cast("bigint").alias("run_seq"), op.cast("bigint").alias("op_seq"))


def check_paths(paths: Sequence[str]) -> list[str]:
    paths = list(paths)
    if not paths:
        raise ValueError("at least one field is required")
    for path in paths:
        if not _PATH.fullmatch(path):
            raise ValueError(f"bad field path {path!r}")
        if any(other.startswith(path + ".") for other in paths):
            raise ValueError(f"field {path!r} overlaps another field of the same operation")
    return paths


# Building records ----------------------------------------------------------------------


def _before(paths: Sequence[str], ancestors: bool) -> Column:
    """State of each path, plus the scalar ancestors a set would replace."""
    fields = F.col("fields")
    listed = F.array(*[F.lit(p) for p in paths])
    own = F.map_from_arrays(listed, F.transform(listed, lambda p: leafs.state_of(fields, p))).cast(_BEFORE)
    if not ancestors:
        return own
    parents = sorted({p.rsplit(".", n)[0] for p in paths for n in range(1, p.count(".") + 1)} - set(paths))
    if not parents:
        return own
    replaced = F.map_filter(fields, lambda k, _: k.isin(parents))
    states = F.transform_values(
        replaced, lambda _, v: F.struct(F.lit(True).alias("exists"), v.alias("value"))
    ).cast(_BEFORE)
    return F.map_concat(own, states)


def _record(
    docs: DataFrame, run: Run, op_seq: int, operation: str, changed: Sequence[str], before: Column, after: Column
) -> DataFrame:
    supported = operation in ("update_doc", "remove_fields")
    return docs.select(
        F.col("_index").alias("index"),
        F.col("_id").alias("doc_id"),
        F.col("_day").alias("doc_day"),
        F.lit(operation).alias("operation"),
        F.array(*[F.lit(c) for c in changed]).cast("array<string>").alias("changed_fields"),
        F.lit(supported).alias("rollback_supported"),
        before.cast(_BEFORE).alias("before"),
        after.cast("map<string,string>").alias("after"),
        *[c.alias(n) for n, c in run.stamp(op_seq).items()],
    ).select(*PATCH_COLUMNS)


def set_patch(
    docs: DataFrame, query: dict[str, Any] | None, values: dict[str, Any], run: Run, op_seq: int = 1, now: Any = None
) -> DataFrame:
    """Records that set dotted paths on every matching document.

    Values may be columns over the document, which makes the patch per-document logic.
    The matching set and the before-state come from one snapshot.
    """
    paths = check_paths(list(values))
    after = F.map_from_arrays(
        F.array(*[F.lit(p) for p in paths]), F.array(*[leafs.to_leaf(v) for v in values.values()])
    )
    return _record(where(docs, query, now), run, op_seq, "update_doc", paths, _before(paths, True), after)


def remove_patch(
    docs: DataFrame, query: dict[str, Any] | None, paths: Sequence[str], run: Run, op_seq: int = 1, now: Any = None
) -> DataFrame:
    """Records that remove paths; a document without them is recorded too."""
    paths = check_paths(paths)
    return _record(
        where(docs, query, now), run, op_seq, "remove_fields", paths, _before(paths, False), F.create_map()
    )


def delete_patch(docs: DataFrame, query: dict[str, Any] | None, run: Run, op_seq: int = 1) -> DataFrame:
    after = F.create_map(F.lit("deleted"), F.lit("true"))
    return _record(where(docs, query), run, op_seq, "delete_doc", [], F.create_map(), after)


def create_record(docs: DataFrame, run: Run, op_seq: int = 1) -> DataFrame:
    after = F.create_map(F.lit("created"), F.lit("true"))
    return _record(docs, run, op_seq, "index_doc", [], F.create_map(), after)


# Merge on read -----------------------------------------------------------------------------


def last_operations(log: DataFrame) -> DataFrame:
    """Per document: ``ops``, the last operation on each path, and ``deleted_seq``.

    The first aggregate is per (document, path) and combines map-side, so any number of
    records on one document or path shrinks to one row before it is grouped; the second
    only gathers the distinct paths of a document.
    """
    seq = F.struct("run_seq", "op_seq")
    sets = F.transform(
        F.map_entries("after"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))
    )
    removes = F.transform(
        F.col("changed_fields"), lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("value"))
    )
    nothing = F.array(F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("value")))
    touched = (
        F.when(F.col("operation") == "update_doc", sets)
        .when(F.col("operation") == "remove_fields", removes)
        .when(F.col("operation") == "delete_doc", nothing)
    )
    rows = log.where(F.col("operation") != "index_doc").select(
        "index", "doc_id", seq.alias("seq"), F.explode(touched).alias("op")
    )
    per_path = rows.groupBy("index", "doc_id", F.col("op.path").alias("path")).agg(
        F.max(F.struct("seq", "op.value")).alias("last"),
        F.max(F.when(F.col("op.value").isNotNull(), F.col("seq"))).alias("set_seq"),
    )
    op = F.struct("path", F.col("last.value").alias("value"), F.col("last.seq").alias("seq"), "set_seq")
    return per_path.groupBy("index", "doc_id").agg(
        F.collect_list(F.when(F.col("path") != "", op)).alias("ops"),
        F.max(F.when(F.col("path") == "", F.col("last.seq"))).alias("deleted_seq"),
    )


def _kills(leaf: Column, op: Column, since: Column | None) -> Column:
    """The operation removes a leaf written at ``since`` (stored leaves: None)."""
    at_or_above = F.startswith(leaf, op["path"]) & ((leaf == op["path"]) | leafs.is_under(leaf, op["path"]))
    below = leafs.is_under(op["path"], leaf)
    if since is None:
        return at_or_above | (below & op["set_seq"].isNotNull())
    return (at_or_above & (op["seq"] > since)) | (below & F.coalesce(op["set_seq"] > since, F.lit(False)))


def _touches(path: str, since: Column | None):
    return lambda op: _kills(F.lit(path), op, since)


def _set_leaves(op: Column) -> Column:
    """Leaves a set writes: one for a plain value, one per leaf of an object value."""
    plain = F.array(F.struct(op["path"].alias("key"), op["value"].alias("value"), op["seq"].alias("seq")))

    def nested(entries: Column) -> Column:
        leaves = F.transform(
            entries,
            lambda e: F.struct(
                F.concat(op["path"], F.lit("."), e["key"]).alias("key"),
                e["value"].alias("value"),
                op["seq"].alias("seq"),
            ),
        )
        return F.when(F.size(entries) > 0, leaves).otherwise(plain)

    objects = leafs.let(leafs.leaf_entries(F.try_parse_json(op["value"])), nested)
    return F.when(op["value"].startswith("{"), objects).otherwise(plain)


def patched_fields(fields: Column, ops: Column, since: Column | None = None) -> Column:
    """Leaf map after the operations, of those later than ``since`` where it is given."""

    def rewrite(operations: Column) -> Column:
        kept = F.map_filter(fields, lambda k, _: ~F.exists(operations, lambda o: _kills(k, o, since)))
        counts = lambda o: o["value"].isNotNull() if since is None else o["value"].isNotNull() & (o["seq"] > since)
        sets = F.filter(operations, counts)
        leaves = F.flatten(F.transform(sets, _set_leaves))
        alive = F.filter(leaves, lambda leaf: ~F.exists(operations, lambda o: _kills(leaf["key"], o, leaf["seq"])))
        pairs = F.transform(alive, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value")))
        return F.map_concat(kept, leafs.unique_map(pairs))

    return leafs.let(ops, rewrite)


def apply_patches(docs: DataFrame, log: DataFrame, promoted: bool = True) -> DataFrame:
    """Documents after every record of the log.

    One equi join on (table, id) against one row per patched document; the log side is
    normally the small one, and adaptive execution picks broadcast or a skew-safe sort
    merge from its measured size. Columns other than the leaf map are recomputed only
    for patched rows, and only when ``promoted`` is set. Where rows carry their age
    (``BORN``), a record counts for rows older than itself only.
    """
    ops = last_operations(log).select(
        F.col("index").alias("_index"), F.col("doc_id").alias("_id"), "ops", "deleted_seq"
    )
    since = F.col(BORN) if BORN in docs.columns else None
    alive = F.col("deleted_seq").isNull()
    if since is not None:
        alive = alive | (F.col("deleted_seq") < since)
    joined = docs.join(ops, ["_index", "_id"], "left").where(alive)
    hit = F.col("ops").isNotNull() & (F.size("ops") > 0)
    new = F.when(hit, patched_fields(F.col("fields"), F.col("ops"), since)).otherwise(F.col("fields"))
    out = joined.withColumn("_new", new)
    columns: list[Column] = []
    for name in docs.columns:
        path = _PROMOTED_PATHS.get(name)
        if name == "fields":
            columns.append(F.col("_new").alias("fields"))
        elif promoted and path is not None:
            touched = F.exists("ops", _touches(path, since))
            value = leafs.from_leaf(F.col("_new")[path], PROMOTED[path])
            columns.append(F.when(hit & touched, value).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns)


_PROMOTED_PATHS = {column_of(p): p for p in PROMOTED}


# Reports ---------------------------------------------------------------------------------


def read_run(log: DataFrame, run_id: str) -> DataFrame:
    """All records of a run, oldest first."""
    return log.where(F.col("run_id") == run_id).orderBy("run_seq", "op_seq", "index", "doc_id")


def run_summary(log: DataFrame, run: Run, dry_run: bool = False) -> DataFrame:
    """One row: documents created, updated and deleted by a run."""
    mine = log.where(F.col("run_id") == run.run_id)
    done = mine.agg(
        F.count_if(F.col("operation") == "index_doc").alias("docs_created"),
        F.count_if(F.col("operation").isin("update_doc", "remove_fields")).alias("docs_updated"),
        F.count_if(F.col("operation") == "delete_doc").alias("docs_deleted"),
    )
    return done.select(
        F.lit(run.run_id).alias("run_id"),
        F.lit(run.enrichment).alias("enrichment"),
        F.lit(run.cluster).alias("cluster"),
        F.lit(dry_run).alias("dry_run"),
        "*",
    )


def leaf_text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
