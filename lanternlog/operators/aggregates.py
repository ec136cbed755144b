"""Reports over documents. Every group-by combines map-side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType

from lanternlog.functions.projections import severity_label
from lanternlog.model import TS


def timeline(df: DataFrame, now: Column, minutes: int = 60, buckets: int = 12) -> DataFrame:
    """Counts per fixed interval, gaps filled with 0: ``bucket_ms, count``.

    Buckets are aligned to the epoch, so the range can touch one more than asked for;
    the last ``buckets`` are kept. Later events have no upper bound and move the end.
    """
    if minutes <= 0 or buckets <= 0 or minutes * 60_000 // buckets == 0:
        raise ValueError("minutes and buckets must be positive, a bucket at least 1 ms")
    width = minutes * 60_000 // buckets
    start = now - F.make_dt_interval(mins=F.lit(minutes))
    bucket = F.floor(F.unix_millis(TS) / width)
    counts = df.where(F.col(TS) >= start).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ends = df.sparkSession.range(1).select(
        F.floor(F.unix_millis(start) / width).alias("low"),
        F.greatest(F.floor(F.unix_millis(now) / width), F.coalesce(counts.agg(F.max("b")).scalar(), F.lit(0))).alias(
            "high"
        ),
    )
    first = F.greatest(F.col("low"), F.col("high") - buckets + 1)
    spine = ends.select(F.explode(F.sequence(first, F.col("high"))).alias("b"))
    return spine.join(counts, "b", "left").select(
        (F.col("b") * width).alias("bucket_ms"), F.coalesce("n", F.lit(0)).alias("count")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent non-null values: ``key, count``; ties by key. A list counts each value once per row."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, ArrayType):
        value = F.explode(F.array_distinct(value))
    counts = df.select(value.alias("key")).where("key is not null").groupBy("key").count()
    return counts.orderBy(F.col("count").desc(), "key").limit(n)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """``facet, key, count`` for severity (by label) and dataset, plus a ``total`` row.

    All three come from one scan: counts per (severity, dataset) first, then small roll-ups.
    """
    cube = alerts.groupBy("alert_severity", "event_dataset").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("alert_severity").between(1, 4), severity_label(F.col("alert_severity"))).otherwise(
        F.col("alert_severity").cast("string")
    )
    facets = cube.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("facet"), F.lit("all").alias("key"), F.lit(0).alias("sort")),
                F.struct(F.lit("severity").alias("facet"), label.alias("key"), F.col("alert_severity").alias("sort")),
                F.struct(F.lit("dataset").alias("facet"), F.col("event_dataset").alias("key"), F.lit(0).alias("sort")),
            )
        ).alias("f"),
        "n",
    ).where("f.key is not null")
    counts = facets.groupBy("f.facet", "f.key", "f.sort").agg(F.sum("n").alias("count"))
    order = W.partitionBy("facet").orderBy(F.col("count").desc(), "sort", "key")
    return counts.withColumn("_r", F.row_number().over(order)).where("_r <= 10").select("facet", "key", "count")


def flow_facets(flows: DataFrame, exact: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct source and destination addresses of all flows, one row.

    Approximate by default (HyperLogLog++, one small sketch per task); ``exact`` counts
    the values themselves.
    """
    if exact:
        return flows.agg(
            F.count_distinct("source_ip").alias("unique_src"), F.count_distinct("destination_ip").alias("unique_dst")
        )
    return flows.agg(
        F.approx_count_distinct("source_ip", rsd).alias("unique_src"),
        F.approx_count_distinct("destination_ip", rsd).alias("unique_dst"),
    )


def top_protocol(flows: DataFrame) -> DataFrame:
    """Most frequent transport (ties: first by name), ``—`` when there is none."""
    best = top_values(flows, "network_transport", 1).agg(F.first("key").alias("top"))
    return best.select(F.coalesce("top", F.lit("—")).alias("top_protocol"))


def counts_by_table(df: DataFrame) -> DataFrame:
    return df.groupBy("_index").agg(F.count(F.lit(1)).alias("docs"))


def overview(docs: DataFrame, is_alert: Column) -> DataFrame:
    """One row from one scan: documents, tables, alerts, critical alerts and the status colour."""
    per_table = docs.groupBy("_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_alert).alias("a"),
        F.count_if(is_alert & (F.col("alert_severity") == 1)).alias("c"),
    )
    colour = F.when(F.col("critical") > 0, "red").when(F.col("alerts") > 0, "amber").otherwise("green")
    return per_table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"),
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("alerts"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("critical"),
    ).withColumn("status", colour)


def run_list(audit: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs: latest record, most frequent enrichment and cluster, operations."""
    per_value = audit.groupBy("run_id", "enrichment", "cluster").agg(
        F.max(TS).alias("latest"), F.count("operation").alias("ops"), F.count(F.lit(1)).alias("n")
    )
    value = F.explode(
        F.array(
            F.struct(F.lit("enrichment").alias("kind"), F.col("enrichment").alias("value")),
            F.struct(F.lit("cluster").alias("kind"), F.col("cluster").alias("value")),
        )
    )
    per_kind = (
        per_value.select("run_id", "latest", "ops", "n", value.alias("v"))
        .groupBy("run_id", "v.kind", "v.value")
        .agg(F.max("latest").alias("latest"), F.sum("ops").alias("ops"), F.sum("n").alias("n"))
    )

    def most_frequent(kind: str) -> Column:
        # Most rows first, then by name; a null rank is ignored.
        rank = F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))
        return F.coalesce(F.min_by("value", rank), F.lit(""))

    runs = per_kind.groupBy("run_id").agg(
        F.max("latest").alias("latest"),
        most_frequent("enrichment").alias("enrichment"),
        most_frequent("cluster").alias("cluster"),
        F.sum(F.when(F.col("kind") == "cluster", F.col("ops"))).alias("operations"),
    )
    return runs.orderBy(F.col("latest").desc(), "run_id").limit(limit)


def run_totals(audit: DataFrame) -> DataFrame:
    """Runs and operations, one row; grouping by run first keeps the distinct count mergeable."""
    per_run = audit.groupBy("run_id").agg(F.count("operation").alias("n"))
    return per_run.agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("operations"))


def vendor_rollup(df: DataFrame, vendor: Column, category: Column) -> DataFrame:
    """Rows per vendor with its category, by vendor."""
    return (
        df.groupBy(vendor.alias("vendor"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("category", category)
        .orderBy("vendor")
    )


def recent(df: DataFrame, n: int, *keys: Sequence[str] | str) -> DataFrame:
    return df.orderBy(F.col(TS).desc(), *keys).limit(n)
