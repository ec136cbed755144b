"""Rolling a run back: conflict test, plan, compensating records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from lanternlog.model import TS
from lanternlog.operators.patches import PATCH_COLUMNS, Run

_KEY = ["cluster", "index", "doc_id", "field"]


def live_records(log: DataFrame) -> DataFrame:
    """Records that still count: reverted runs and their compensation are left out.

    The list of reverted runs is one row per rollback ever made, far smaller than the
    log; adaptive execution broadcasts it when its size allows.
    """
    reverted = log.where(F.col("reverts_run_id").isNotNull()).select(F.col("reverts_run_id").alias("run_id")).distinct()
    return log.where(F.col("reverts_run_id").isNull()).join(reverted, "run_id", "left_anti")


def later_changes(log: DataFrame, run_id: str | None = None, strict_reference: bool = False) -> DataFrame:
    """Revertible records that another run changed later on a shared field: ``run_id, run_seq, op_seq, …``.

    Rather than pairing the records of a field with each other, the log is reduced to the
    last change per (field, run) and then to the two latest runs per field: a record is
    overtaken when the latest other run is later than it. Both reductions happen before
    the shuffle, so a field that everybody changes costs no more than any other.
    """
    usable = log if strict_reference else live_records(log)
    usable = usable.where("rollback_supported")
    changes = usable.select(
        *_KEY[:3], "run_id", F.struct(TS, "run_seq", "op_seq").alias("seq"), F.explode("changed_fields").alias("field")
    )
    per_run = changes.groupBy(*_KEY, "run_id").agg(F.max("seq").alias("seq"))
    order = W.partitionBy(*_KEY).orderBy(F.col("seq").desc(), "run_id")
    top2 = per_run.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    latest = top2.groupBy(*_KEY).agg(
        F.max(F.when(F.col("_r") == 1, F.col("run_id"))).alias("last_run"),
        F.max(F.when(F.col("_r") == 1, F.col("seq"))).alias("last_seq"),
        F.max(F.when(F.col("_r") == 2, F.col("seq"))).alias("other_seq"),
    )
    records = usable if run_id is None else usable.where(F.col("run_id") == run_id)
    own = records.select(
        *_KEY[:3], "run_id", "run_seq", "op_seq", TS, F.explode("changed_fields").alias("field")
    )
    rival = F.when(F.col("last_run") != F.col("run_id"), F.col("last_seq")).otherwise(F.col("other_seq"))
    # Order between runs is by time alone; the sequence only breaks ties within a run.
    overtaken = own.join(latest, _KEY).where(rival[TS] > F.col(TS))
    return overtaken.groupBy("run_id", "run_seq", "op_seq", *_KEY[:3]).agg(F.count(F.lit(1)).alias("fields"))


def rollback_plan(log: DataFrame, run_id: str) -> DataFrame:
    """Dry run: every revertible record of the run and whether it is blocked."""
    mine = log.where((F.col("run_id") == run_id) & F.col("rollback_supported"))
    blocked = later_changes(log, run_id).select("op_seq", "cluster", "index", "doc_id", F.lit(True).alias("blocked"))
    return mine.join(blocked, ["op_seq", "cluster", "index", "doc_id"], "left").select(
        "op_seq", "cluster", "index", "doc_id", "doc_day", "operation",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


def compensation(log: DataFrame, run_id: str, undo: Run) -> DataFrame:
    """Records that put the fields of a run back.

    Closed form of replaying the run backwards: per (document, path) the before-state of
    the run's earliest record. Paths that were first touched later are put back first,
    which settles paths that lie inside one another. A second rollback yields nothing.
    """
    done = log.where(F.col("reverts_run_id") == run_id).select(F.col("reverts_run_id").alias("run_id")).distinct()
    mine = log.where((F.col("run_id") == run_id) & F.col("rollback_supported")).join(done, "run_id", "left_anti")
    # A removal only comes back where there was something.
    states = mine.select(
        "cluster", "index", "doc_id", "doc_day", "operation", "op_seq", F.explode("before").alias("field", "state")
    ).where((F.col("operation") == "update_doc") | F.col("state.exists"))
    first = states.groupBy("cluster", "index", "doc_id", "doc_day", "field").agg(
        F.min_by("state", "op_seq").alias("state"), F.min("op_seq").alias("op_seq")
    )
    last = mine.agg(F.max("op_seq")).scalar()
    restore = F.col("state.exists")
    grouped = first.groupBy(
        "cluster", "index", "doc_id", "doc_day", "op_seq", restore.alias("restore")
    ).agg(
        F.collect_list("field").alias("changed_fields"),
        F.collect_list(F.struct("field", F.coalesce("state.value", F.lit("null")))).alias("pairs"),
    )
    # Within a step, removals (even numbers) come before restored values (odd numbers).
    step = (last - F.col("op_seq")) * 2 + F.when(F.col("restore"), 1).otherwise(0) + 1
    stamp = undo.stamp(0)
    return grouped.select(
        "index", "doc_id", "doc_day",
        F.when(F.col("restore"), "update_doc").otherwise("remove_fields").alias("operation"),
        "changed_fields",
        F.lit(False).alias("rollback_supported"),
        F.create_map().cast("map<string,struct<exists:boolean,value:string>>").alias("before"),
        F.when(F.col("restore"), F.map_from_entries("pairs")).otherwise(F.create_map().cast("map<string,string>")).alias("after"),
        # Back to where the change was made, whatever store the rollback was called on.
        "cluster",
        step.cast("bigint").alias("op_seq"),
        F.lit(run_id).alias("reverts_run_id"),
        *[stamp[n].alias(n) for n in ("run_id", "run_seq", TS, "enrichment")],
    ).select(*PATCH_COLUMNS)


def rollback_result(log: DataFrame, run_id: str) -> DataFrame:
    """``reverted`` (revertible records) and ``total`` (all records) of a run."""
    mine = log.where(F.col("run_id") == run_id)
    return mine.agg(
        F.count_if("rollback_supported").alias("reverted"), F.count(F.lit(1)).alias("total")
    )
