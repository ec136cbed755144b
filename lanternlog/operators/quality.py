"""Samples and quality gates of parsed text, and service-log clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions.fields import from_leaf
from lanternlog.functions.text import blank, strip
from lanternlog.model import BOOKKEEPING_KEYS

HEAD_LINES = 400


def service_line(line: Column) -> Column:
    """One service log line: structured ones become ``ts [LEVEL] message``, others stay."""
    text = strip(line)
    body = F.try_parse_json(text)
    item = lambda key: F.try_variant_get(body, f"$['{key}']", "string")
    structured = text.startswith("{") & text.contains('"log.level"') & body.isNotNull()
    stamp = F.replace(F.substring(F.coalesce(item("@timestamp"), F.lit("")), 1, 19), F.lit("T"), F.lit(" "))
    shown = F.concat(
        stamp, F.lit(" ["), F.upper(F.coalesce(item("log.level"), F.lit("info"))), F.lit("] "),
        F.coalesce(item("message"), text),
    )
    return F.when(structured, shown).otherwise(text)


def normalize_service_logs(df: DataFrame, column: str = "line") -> DataFrame:
    return df.where(~blank(F.col(column))).withColumn(column, service_line(F.col(column)))


def representative_sample(lines: DataFrame, n: int = 24) -> DataFrame:
    """Per file: its first 400 non-blank lines, thinned to ``n`` distinct ones.

    Short files keep every line. Longer ones take the head, the middle, the tail and
    the longest lines, in that order. Taking the first 400 is a per-partition top-k
    before the shuffle, so everything after it is at most 400 lines per file.
    """
    by_file = W.partitionBy("file")
    head = (
        lines.where(~blank(F.col("line")))
        .withColumn("rn", F.row_number().over(by_file.orderBy("line_no")))
        .where(f"rn <= {HEAD_LINES}")
    )
    i, total = F.col("rn") - 1, F.col("total")
    mid = F.floor(total / 2)
    longest = F.row_number().over(by_file.orderBy(F.length("line").desc(), "rn"))
    pick = (
        F.when(total <= n, i)
        .when(i < 8, i)
        .when((i >= mid - 4) & (i < mid + 4), 8 + i - (mid - 4))
        .when(i >= total - 8, 16 + i - (total - 8))
        .when(F.col("by_length") <= 20, 23 + F.col("by_length"))
    )
    chosen = (
        head.withColumns({"total": F.count("*").over(by_file), "by_length": longest})
        .withColumn("pick", pick.cast("bigint"))
        .where(F.col("pick").isNotNull())
    )
    # Short files keep duplicates, so there every line is its own group.
    own = F.when(total <= n, F.col("pick")).otherwise(F.lit(-1).cast("bigint"))
    distinct = chosen.groupBy("file", "line", own.alias("own")).agg(F.min("pick").alias("pick"))
    order = W.partitionBy("file").orderBy("pick")
    ranked = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("file", "rank", "line")


def field_count(fields: Column) -> Column:
    """Distinct top-level keys of a leaf map that are not bookkeeping."""
    keys = F.array_distinct(F.transform(F.map_keys(fields), lambda k: F.substring_index(k, ".", 1)))
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in BOOKKEEPING_KEYS])))


def parse_gate(df: DataFrame, n_fields: Column, failed: Column) -> DataFrame:
    """Verdict on a parser's output in one pass: ``docs, good, errors, avg_fields, passed``."""
    good = F.count_if(~failed & (n_fields > 0))
    docs, errors = F.count(F.lit(1)), F.count_if(failed)
    average = F.coalesce(F.avg(F.when(~failed, n_fields)), F.lit(0.0))
    report = df.agg(docs.alias("docs"), good.alias("good"), errors.alias("errors"), average.alias("avg_fields"))
    third = F.greatest(F.lit(1), F.floor(F.col("docs") / 3))
    half = F.greatest(F.lit(1), F.floor(F.col("docs") / 2))
    return report.withColumn(
        "passed",
        (F.col("docs") > 0) & (F.col("good") >= half) & (F.col("avg_fields") >= 2.0) & (F.col("errors") <= third),
    )


def ingest_quality(docs: DataFrame) -> DataFrame:
    """``total, errors, parse_errors, avg_fields`` over every row of a parsed table."""
    filled = lambda path: from_leaf(F.col("fields")[path]).isNotNull()
    return docs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(filled("error.message")).alias("errors"),
        F.count_if(filled("parse_error")).alias("parse_errors"),
        F.coalesce(F.avg(field_count(F.col("fields"))), F.lit(0.0)).alias("avg_fields"),
    )


def ingest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents added per table, never negative; inputs are ``(_index, docs)`` counts."""
    return after.join(before.withColumnRenamed("docs", "baseline"), "_index", "left").select(
        "_index",
        F.greatest(F.col("docs") - F.coalesce("baseline", F.lit(0)), F.lit(0)).cast("bigint").alias("added"),
        F.col("docs").alias("total"),
    )
