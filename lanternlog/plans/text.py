"""Samples, tails and service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.operators import feeds, quality
from lanternlog.plans.registry import query
from lanternlog.sources.bind import Tables, document_lines

_LINES_SQL = """
WITH l AS (SELECT source AS file, doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""


@query(
    "sample_lines",
    _LINES_SQL
    + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, pos) - 1 AS i FROM l WHERE NOT regexp_matches(line, '^\\s*$')),
    h AS (SELECT *, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file ORDER BY length(line) DESC, i) AS bl FROM r WHERE i < 400),
    p AS (SELECT *, CASE WHEN n <= 24 THEN i WHEN i < 8 THEN i WHEN i >= n // 2 - 4 AND i < n // 2 + 4 THEN 8 + i - (n // 2 - 4)
      WHEN i >= n - 8 THEN 16 + i - (n - 8) WHEN bl <= 20 THEN 23 + bl END AS pick FROM h),
    d AS (SELECT file, line, min(pick) AS pick FROM p WHERE pick IS NOT NULL GROUP BY file, line, CASE WHEN n <= 24 THEN i END),
    o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pick) AS rank FROM d)
    SELECT file, CAST(rank AS INTEGER) AS rank, line FROM o WHERE rank <= 24
    """,
    docs=False,
)
def sample_lines(t: Tables) -> DataFrame:
    return quality.representative_sample(document_lines(t.table("documents")))


@query(
    "tail_lines",
    _LINES_SQL
    + """
    SELECT file, CAST(rn AS INTEGER) AS from_end, line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id DESC, pos DESC) AS rn FROM l)
    WHERE rn <= 40
    """,
    docs=False,
)
def tail_lines(t: Tables) -> DataFrame:
    return feeds.tail_lines(document_lines(t.table("documents")), 40)


@query(
    "service_logs",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' [WARN] order ' || CAST(o_orderkey AS VARCHAR)
      WHEN 1 THEN ' [INFO] no time' ELSE 'plain ' || o_orderpriority END AS line FROM orders WHERE o_orderkey % 4 <> 3
    """,
    docs=False,
)
def service_logs(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    structured = F.concat(
        F.lit('{"@timestamp":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('.123Z","log.level":"warn","message":"order '), key.cast("string"), F.lit('"}'),
    )
    line = (
        F.when(key % 4 == 0, structured)
        .when(key % 4 == 1, F.lit('{"log.level":"info","message":"no time"}'))
        .when(key % 4 == 2, F.concat(F.lit("  plain "), "o_orderpriority", F.lit(" ")))
        .otherwise(F.lit("  "))
    )
    return quality.normalize_service_logs(t.table("orders").select("o_orderkey", line.alias("line")))
