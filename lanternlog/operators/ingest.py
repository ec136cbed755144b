"""Files of unknown format into dated datasets."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.fields import to_leaf
from lanternlog.model import TS
from lanternlog.operators.parse import Pipelines, date_value, parse_cef
from lanternlog.session import spread, work_dir
from lanternlog.sources import lines as L
from lanternlog.sources.store import Store


@dataclass(frozen=True)
class Options:
    """``pipeline`` wins over the detected format; ``base`` collects all files in one dataset.

    ``rebase`` sets every event to the ingest time and keeps its own in ``event.created``.
    """

    pipeline: str = ""
    base: str = ""
    mode: str = "append"
    rebase: bool = False


def leaves_of_columns(df: DataFrame, skip: set[str]) -> Column:
    """Leaf map of plain columns; string maps are spread, nulls left out."""
    parts = []
    for name, dtype in df.dtypes:
        if name in skip:
            continue
        if dtype == "map<string,string>":
            spread = F.transform(
                F.map_entries(name), lambda e: F.struct(e["key"].alias("key"), to_leaf(e["value"]).alias("value"))
            )
            parts.append(F.coalesce(spread, F.array().cast("array<struct<key:string,value:string>>")))
        else:
            parts.append(F.array(F.struct(F.lit(name).alias("key"), to_leaf(F.col(name)).alias("value"))))
    from lanternlog.functions.fields import unique_map

    return unique_map(F.filter(F.concat(*parts), lambda e: e["value"] != "null"))


def _prefixed(entries: Column, prefix: str) -> Column:
    return F.transform(
        entries, lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), to_leaf(e["value"]).alias("value"))
    )


def _cef_documents(lines: DataFrame, now: Column) -> DataFrame:
    parsed = parse_cef(lines, "line", now)
    names = parsed.schema["cef"].dataType.names
    head = F.array(*[F.struct(F.lit(f"cef.{n}").alias("key"), to_leaf(F.col("cef")[n]).alias("value")) for n in names])
    empty = F.array().cast("array<struct<key:string,value:string>>")
    tail = F.coalesce(_prefixed(F.map_entries("extensions"), "cef.extensions."), empty)
    text = F.array(F.struct(F.lit("message").alias("key"), to_leaf(F.col("message")).alias("value")))
    leaves = F.map_from_entries(F.when(F.col("cef").isNotNull(), F.concat(head, tail)).otherwise(text))
    return parsed.select("file", leaves.alias("fields"), F.coalesce(F.col(TS), now).alias("stamp"))


def _json_documents(lines: DataFrame, now: Column) -> DataFrame:
    parsed = L.json_lines(lines).where("accepted")
    text = lambda path: F.try_variant_get(F.try_parse_json(F.col("fields")[path]), "$", "string")
    stamp = F.coalesce(date_value(text(TS)), date_value(text("timestamp")), now)
    return parsed.select("file", "fields", stamp.alias("stamp"))


def _piped_documents(lines: DataFrame, now: Column, pipelines: Pipelines, name: str) -> DataFrame:
    step = pipelines.resolve(name)
    parsed = step(L.raw_lines(lines.select("file", "line"), now).drop("line"))
    return parsed.select("file", leaves_of_columns(parsed, {"file", TS}).alias("fields"), F.coalesce(F.col(TS), now).alias("stamp"))


def documents_of_files(
    lines: DataFrame, options: Options, now: Column, pipelines: Pipelines | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lines of files -> (documents with ``file``, strategy per file).

    The format is one row per file; joined back, it routes every line. A file is read
    once per route that occurs, and adaptive execution splits a file that is far larger
    than the others.
    """
    pipelines = pipelines or Pipelines()
    chosen = F.lit(options.pipeline) if options.pipeline else F.lit(None).cast("string")
    known = F.lit(options.pipeline in pipelines.steps)
    plan = L.detect_format(lines).select("file", "format", L.plan_ingest(F.col("format"), chosen, known).alias("strategy"))
    routed = lines.join(plan.select("file", "strategy"), "file")
    parts = [
        _json_documents(routed.where("strategy = 'json'"), now),
        _cef_documents(routed.where("strategy = 'cef'"), now),
    ]
    if options.pipeline in pipelines.steps:
        parts = [_piped_documents(lines, now, pipelines, options.pipeline)]
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.unionByName(part)
    base = F.lit(options.base) if options.base else L.dataset_of_file("file")
    if options.rebase:
        created = to_leaf(F.date_format("stamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        docs = docs.withColumn("fields", F.map_concat(
            F.map_filter("fields", lambda k, _: k != "event.created"), F.create_map(F.lit("event.created"), created)))
        docs = docs.withColumn("stamp", now)
    out = L.promote(docs.withColumns({"_base": base}), F.col("_base"), F.col("stamp"), keep=["file", "_base"])
    return out, plan


def ingest_files(
    store: Store, path: str, options: Options = Options(), pipelines: Pipelines | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Ingest a file, glob or folder. Returns ``file, format, strategy, docs, rejected, error``.

    A file that cannot be routed or read is reported with its error; the others go on. Of a damaged
    archive the lines before the damage are ingested and the error is reported. JSON lines
    that are no objects are counted per file and kept under ``quarantine/`` of the store.
    """
    spark = store.spark
    stamp = F.lit(now or dt.datetime.now(dt.timezone.utc))
    staged = work_dir(spark, "ingest")
    # Files are read and unpacked once; formats, documents, rejects and counts come from what is written here.
    archives = L.read_archives(spark, path)
    plain = L.read_log_files(spark, path).withColumn("error", F.lit(None).cast("string"))
    read = plain.unionByName(archives)
    read.write.parquet(f"{staged}/lines")
    read = spread(spark.read.schema(read.schema).parquet(f"{staged}/lines"))
    lines, damaged = read.where("error is null").drop("error"), read.where("error is not null").select("file", F.col("error").alias("damage"))
    docs, plan = documents_of_files(lines, options, stamp, pipelines)
    docs.write.parquet(f"{staged}/docs")
    plan.write.parquet(f"{staged}/plan")
    parsed = spark.read.schema(docs.schema).parquet(f"{staged}/docs")
    files = spark.read.schema(plan.schema).parquet(f"{staged}/plan")
    judged = L.json_lines(lines.join(files.where("strategy = 'json'").select("file"), "file"))
    bad = judged.where(~F.col("accepted")).select("file", "line")
    bad.write.parquet(kept := f"{store.root}/quarantine/{staged.rsplit('/', 1)[-1]}")
    # all datasets in one job and one commit
    store.write_many(parsed, options.mode)
    n = lambda c: F.count(F.lit(1)).alias(c)
    counts = parsed.groupBy("file").agg(n("docs"))
    rejected = spark.read.schema(bad.schema).parquet(kept).groupBy("file").agg(n("rejected"))
    found = L.listed_files(spark, path)
    slashes = lambda df: df.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    report = files.join(counts, "file", "left").join(rejected, "file", "left")
    report = slashes(report).join(slashes(found), "file", "full_outer").join(slashes(damaged), "file", "left")
    unread = F.when(F.col("hidden"), "error: hidden name").when(F.col("size") == 0, "error: empty file").otherwise("error: not readable")
    strategy = F.coalesce("strategy", unread)
    failed = strategy.startswith("error")
    return report.select(
        "file", F.coalesce("format", F.lit("other")).alias("format"), strategy.alias("strategy"),
        F.when(failed, 0).otherwise(F.coalesce("docs", F.lit(0))).cast("bigint").alias("docs"),
        F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"),
        F.coalesce(F.concat(F.lit("error: damaged: "), "damage"), F.when(failed, strategy)).alias("error"),
    )
