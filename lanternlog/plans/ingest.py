"""Line sources, parsers and ingest reports."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from lanternlog.functions.fields import expand_fields, from_leaf
from lanternlog.functions.projections import safe_base
from lanternlog.model import TS
from lanternlog.operators import aggregates, parse, quality
from lanternlog.operators.ingest import Options, ingest_files
from lanternlog.plans.registry import millis, query
from lanternlog.sources import lines as L
from lanternlog.sources.bind import CEF_SQL, Tables, cef_lines, document_lines, event_lines, order_lines
from lanternlog.session import work_dir
from lanternlog.sources.store import Store
from lanternlog.streaming.ingest import documents_of

_EVE_SQL = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_id % 50 WHEN 0 THEN 'text' WHEN 1 THEN 'scalar' WHEN 2 THEN 'blank' ELSE 'event' END AS status FROM events)
"""


@query(
    "eve_lines",
    _EVE_SQL
    + """
    SELECT event_id, status, CASE WHEN status = 'event' THEN 'suricata.' || event_type END AS dataset,
      CASE WHEN status = 'event' THEN CAST(8 + CAST(k % 5 <> 0 AS INTEGER) AS INTEGER) END AS leaves FROM e WHERE status <> 'blank'
    """,
    docs=False,
)
def eve_lines(t: Tables) -> DataFrame:
    parsed = L.parse_events(event_lines(t.lines("events")))
    return parsed.select(
        "event_id", "status", from_leaf(F.col("fields")["event.dataset"]).alias("dataset"),
        F.when(F.col("fields").isNotNull(), F.size("fields")).alias("leaves"),
    )


@query(
    "eve_documents",
    _EVE_SQL
    + """
    SELECT 'suricata-' || strftime(ts, '%Y.%m.%d') AS _index, epoch_us(ts) // 1000 AS ts_ms, user_id AS flow_id,
      'suricata.' || event_type AS event_dataset,
      CASE WHEN k % 10 <> 7 THEN CAST(1 + k % 4 AS INTEGER) END AS alert_severity,
      'SIG-' || CAST(k % 10 AS VARCHAR) AS alert_signature,
      CASE WHEN k % 10 = 7 THEN 'alert.severity' ELSE '' END AS malformed
    FROM e WHERE status = 'event'
    """,
    docs=False,
)
def eve_documents(t: Tables) -> DataFrame:
    docs, _ = documents_of(event_lines(t.lines("events")), "suricata", t.now())
    return docs.select(
        "_index", millis(), "flow_id", "event_dataset", "alert_severity", "alert_signature",
        F.array_join("_malformed", ",").alias("malformed"),
    )


@query(
    "eve_quarantine",
    _EVE_SQL
    + "SELECT status, count(*) AS lines FROM e WHERE status IN ('text', 'scalar') GROUP BY status",
    docs=False,
)
def eve_quarantine(t: Tables) -> DataFrame:
    _, bad = documents_of(event_lines(t.lines("events")), "suricata", t.now())
    return bad.groupBy("status").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "drop_fields",
    _EVE_SQL
    + """
    SELECT event_id, 'agent.version,alert.severity,alert.signature,event.dataset,' ||
      CASE WHEN k % 5 <> 0 THEN 'extra.kind,' ELSE '' END || 'flow_id,timestamp' AS paths FROM e WHERE status = 'event'
    """,
    docs=False,
)
def drop_fields(t: Tables) -> DataFrame:
    parsed = L.parse_events(event_lines(t.lines("events"))).where("status = 'event'")
    kept = L.drop_fields(parsed)
    return kept.select("event_id", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("paths"))


@query(
    "expand_documents",
    _EVE_SQL
    + """
    SELECT event_id, '{"agent":{"hostname":"h1","version":"8"},"alert":{"severity":"' ||
      CASE WHEN k % 10 = 7 THEN 'high' ELSE CAST(1 + k % 4 AS VARCHAR) END || '","signature":"SIG-' || CAST(k % 10 AS VARCHAR)
      || '"},"event":{"dataset":"suricata.' || event_type || '"},' ||
      CASE WHEN k % 5 <> 0 THEN '"extra":{"kind":"' || event_type || '"},' ELSE '' END ||
      '"flow_id":' || CAST(user_id AS VARCHAR) || ',"host":{"name":"x"}}' AS body FROM e WHERE status = 'event'
    """,
    docs=False,
)
def expand_documents(t: Tables) -> DataFrame:
    parsed = L.parse_events(event_lines(t.lines("events"))).where("status = 'event'")
    trimmed = L.drop_fields(parsed, ["timestamp"])
    return trimmed.select("event_id", expand_fields(F.col("fields")).alias("body"))


@query(
    "ship_constants",
    """SELECT source_type, module, tags, event_dataset, count(*) AS docs FROM (
      SELECT 'suricata' AS source_type, 'suricata' AS module, 'suricata' AS tags, event_dataset FROM docs) GROUP BY ALL""",
)
def ship_constants(t: Tables) -> DataFrame:
    shipped = L.with_constants(t.docs().select("event_dataset"))
    keys = ["source_type", "module", F.concat_ws(",", "tags").alias("tags"), "event_dataset"]
    return shipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "json_ingest",
    _EVE_SQL
    + "SELECT status = 'event' AS accepted, count(*) AS docs FROM e WHERE status <> 'blank' GROUP BY 1",
    docs=False,
)
def json_ingest(t: Tables) -> DataFrame:
    parsed = L.json_lines(event_lines(t.lines("events")), "value")
    return parsed.groupBy("accepted").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "raw_ingest",
    """
    SELECT source AS file, count(*) AS docs, CAST(sum(length(m)) AS BIGINT) AS chars, count(DISTINCT now_ms) AS stamps,
      max(now_ms) AS ts_ms FROM (SELECT source, regexp_replace(line, '\\s+$', '') AS m, (SELECT max(epoch_us(ts)) // 1000 FROM events) AS now_ms
      FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE m <> '' GROUP BY source
    """,
    docs=False,
)
def raw_ingest(t: Tables) -> DataFrame:
    docs = L.raw_lines(document_lines(t.table("documents")), t.now())
    return docs.groupBy("file").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("message")).alias("chars"),
        F.count_distinct(TS).alias("stamps"), F.unix_millis(F.max(TS)).alias("ts_ms"),
    )


@query(
    "dated_tables",
    "SELECT _index, strftime(_day, '%Y-%m-%d') AS day, count(*) AS docs, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM docs GROUP BY ALL",
)
def dated_tables(t: Tables) -> DataFrame:
    per_table = t.docs().groupBy("_index", "_day").agg(
        F.count(F.lit(1)).alias("docs"), F.min(TS).alias("a"), F.max(TS).alias("b")
    )
    return per_table.select(
        "_index", F.date_format("_day", "yyyy-MM-dd").alias("day"), "docs",
        F.unix_millis("a").alias("first_ms"), F.unix_millis("b").alias("last_ms"),
    )


@query(
    "slug",
    """
    SELECT p_partkey, CASE WHEN s = '' THEN 'logs' ELSE s END AS base FROM (
      SELECT p_partkey, trim(regexp_replace(lower(CASE WHEN p_partkey % 10 = 0 THEN '__' ELSE p_brand || ' ' || p_name || '.v' || CAST(p_size AS VARCHAR) END),
        '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)
    """,
    docs=False,
)
def slug(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 10 == 0, "__.log").otherwise(
        F.concat(F.lit("/data/in/"), "p_brand", F.lit(" "), "p_name", F.lit(".v"), F.col("p_size").cast("string"), F.lit(".log"))
    )
    return t.table("part").select("p_partkey", safe_base(name).alias("base"))


def _files(t: Tables) -> DataFrame:
    """One file per user: JSON, CEF, prose or numbers by user id."""
    e = event_lines(t.lines("events"))
    u, n = F.col("user_id"), F.col("event_id")
    line = (
        F.when(u % 4 == 0, F.col("value"))
        .when(u % 4 == 1, F.when(n % 7 == 0, "x CEF:0|v").otherwise("plain"))
        .when(u % 4 == 2, "plain text")
        .otherwise(n.cast("string"))
    )
    return e.select(u.alias("file"), n.alias("line_no"), line.alias("line"))


_FORMAT_SQL = """
WITH l AS (SELECT user_id AS file, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  CASE WHEN user_id % 4 = 0 AND event_id % 50 = 2 THEN 'blank' WHEN user_id % 4 = 0 AND event_id % 50 <> 0 THEN 'json'
  WHEN user_id % 4 = 1 AND event_id % 7 = 0 THEN 'cef' WHEN user_id % 4 = 3 THEN 'json' ELSE 'text' END AS kind FROM events),
formats AS (SELECT file, CASE WHEN arg_min(kind, n) FILTER (WHERE kind <> 'blank') = 'json' THEN 'json'
  WHEN bool_or(kind = 'cef' AND rn <= 5) THEN 'cef' ELSE 'other' END AS format FROM l GROUP BY file)
"""


@query("detect_format", _FORMAT_SQL + "SELECT file, format FROM formats", docs=False)
def detect_format(t: Tables) -> DataFrame:
    return L.detect_format(_files(t))


@query(
    "ingest_plan",
    _FORMAT_SQL
    + """
    SELECT strategy, count(*) AS files FROM (SELECT CASE WHEN file % 5 = 1 THEN 'pipeline:apache' WHEN format IN ('json', 'cef') THEN format
      WHEN file % 5 = 2 THEN 'error: unknown pipeline nope' ELSE 'error: text needs a pipeline' END AS strategy FROM formats) GROUP BY 1
    """,
    docs=False,
)
def ingest_plan(t: Tables) -> DataFrame:
    pipeline = F.when(F.col("file") % 5 == 1, "apache").when(F.col("file") % 5 == 2, "nope")
    planned = L.detect_format(_files(t)).select(
        L.plan_ingest(F.col("format"), pipeline, pipeline.isin("apache")).alias("strategy")
    )
    return planned.groupBy("strategy").agg(F.count(F.lit(1)).alias("files"))


@query(
    "cef_parse",
    "WITH "
    + CEF_SQL.strip()
    + """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN '0' END AS version,
      CASE WHEN l_linenumber < 6 THEN split_part(line, '|', 2) END AS vendor,
      CASE WHEN l_linenumber < 6 THEN split_part(line, '|', 3) END AS product,
      CASE WHEN l_linenumber < 6 THEN split_part(line, '|', 5) END AS class_id,
      CASE WHEN l_linenumber < 6 THEN split_part(line, '|', 7) END AS severity,
      CASE WHEN l_linenumber < 6 THEN regexp_extract(line, 'b qty=([0-9]+)', 1) END AS qty,
      CASE WHEN l_linenumber < 6 THEN 'part ' || CAST(l_partkey AS VARCHAR) || ' a=b' END AS msg,
      CASE WHEN l_linenumber < 6 THEN regexp_extract(line, 'price=([0-9]+)', 1) END AS price,
      CASE WHEN l_linenumber >= 6 THEN line END AS message
    FROM cef
    """,
    docs=False,
)
def cef_parse(t: Tables) -> DataFrame:
    parsed = parse.parse_cef(cef_lines(t.lines("lineitem")), "line", t.now())
    return parsed.select(
        "l_orderkey", "l_linenumber", F.col("cef.version").alias("version"), F.col("cef.device_vendor").alias("vendor"),
        F.col("cef.device_product").alias("product"), F.col("cef.device_event_class_id").alias("class_id"),
        F.col("cef.severity").alias("severity"), F.col("extensions")["qty"].alias("qty"),
        F.col("extensions")["msg"].alias("msg"), F.col("extensions")["price"].alias("price"), "message",
    )


_ORDER_PATTERN = r"^%{DATA:timestamp} \[%{WORD:level}\] cust %{NUMBER:cust:int} :: %{GREEDYDATA:kvpairs}$"


@query(
    "grok_kv_date",
    """
    SELECT o_orderkey, CASE WHEN ok THEN epoch_ms(o_orderdate) END AS ts_ms, CASE WHEN ok THEN 'INFO' END AS level,
      CASE WHEN ok THEN o_custkey END AS cust, CASE WHEN ok THEN CAST(o_orderkey + 1 AS VARCHAR) END AS last_order,
      CASE WHEN ok THEN o_orderstatus END AS status,
      CASE WHEN NOT ok THEN 'Provided Grok expressions do not match field value: [broken ' || CAST(o_orderkey AS VARCHAR) || ']' END AS parse_error
    FROM (SELECT *, o_orderkey % 11 <> 10 AS ok FROM orders)
    """,
    docs=False,
)
def grok_kv_date(t: Tables) -> DataFrame:
    parsed = parse.text_log(order_lines(t.lines("orders")), _ORDER_PATTERN)
    return parsed.select(
        "o_orderkey", millis(), "level", "cust", F.col("kv")["order"].alias("last_order"),
        F.col("kv")["status"].alias("status"), "parse_error",
    )


@query(
    "rebase_now",
    "SELECT _id, ts_ms AS created_ms, (SELECT max(ts_ms) FROM docs) AS ts_ms FROM docs",
)
def rebase_now(t: Tables) -> DataFrame:
    moved = parse.rebase_now(t.docs(), t.now())
    return moved.select("_id", F.unix_millis("event_created").alias("created_ms"), millis())


@query(
    "shift_to_now",
    """
    SELECT _id, CASE WHEN k % 10 <> 3 THEN epoch_us(ts) + (SELECT max(epoch_us(ts)) FROM docs)
      - (SELECT min(epoch_us(ts)) FROM docs WHERE k % 10 <> 3) END AS shifted_us FROM docs
    """,
)
def shift_to_now(t: Tables) -> DataFrame:
    # Rows without a readable time stay as they are.
    k = F.regexp_extract("message", "k=([0-9]+)", 1).cast("bigint")
    docs = t.docs().withColumn(TS, F.when(k % 10 != 3, F.col(TS)))
    return parse.shift_to_now(docs, t.now()).select("_id", F.unix_micros(TS).alias("shifted_us"))


@query(
    "dispatch",
    """
    SELECT _id, event_dataset, CASE WHEN event_dataset = 'suricata.dns' OR app_proto = 'dns' THEN message
        WHEN event_dataset = 'suricata.http' OR app_proto = 'http' THEN destination_ip END AS subject,
      CASE WHEN event_dataset = 'suricata.alert' THEN alert_signature END AS title FROM docs
    """,
)
def dispatch(t: Tables) -> DataFrame:
    branches = {
        "suricata.dns": {"subject": F.col("message"), "event_dataset": F.lit("suricata.dns")},
        "suricata.http": {"subject": F.col("destination_ip")},
        "suricata.alert": {"title": F.col("alert_signature")},
    }
    return parse.dispatch(t.docs(), branches).select("_id", "event_dataset", "subject", "title")


@query(
    "parse_gate",
    """
    SELECT count(*) AS docs, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS errors,
      avg(5.0) FILTER (WHERE ok) AS avg_fields, count(*) FILTER (WHERE NOT ok) <= greatest(1, count(*) // 3)
        AND count(*) FILTER (WHERE ok) >= greatest(1, count(*) // 2) AS passed
    FROM (SELECT o_orderkey % 11 <> 10 AS ok FROM orders)
    """,
    docs=False,
)
def parse_gate(t: Tables) -> DataFrame:
    parsed = parse.text_log(order_lines(t.lines("orders")), _ORDER_PATTERN)
    found = F.when(F.col("parse_error").isNull(), 3 + F.size("kv")).otherwise(F.lit(0))
    return quality.parse_gate(parsed, found, F.col("parse_error").isNotNull())


@query(
    "ingest_quality",
    """
    SELECT count(*) AS total, count(*) FILTER (WHERE k % 20 = 0) AS errors, count(*) FILTER (WHERE k % 30 = 0) AS parse_errors,
      floor(avg(CASE WHEN event_type <> 'error' THEN 5 WHEN k >= 95 THEN 8 ELSE 7 END) * 1000) / 1000 AS avg_fields FROM docs
    """,
)
def ingest_quality(t: Tables) -> DataFrame:
    k = F.regexp_extract("message", "k=([0-9]+)", 1).cast("bigint")
    failures = F.map_filter(
        F.create_map(
            F.lit("error.message"), F.when(k % 20 == 0, '"bad"').otherwise("null"),
            F.lit("parse_error"), F.when(k % 30 == 0, '"no match"').otherwise("null"),
        ),
        lambda _, v: v != "null",
    )
    docs = t.full_docs().withColumn("fields", F.map_concat("fields", failures))
    report = quality.ingest_quality(docs)
    return report.withColumn("avg_fields", F.floor(F.col("avg_fields") * 1000) / 1000)


@query(
    "ingest_delta",
    """
    SELECT _index, greatest(a - b, 0) AS added, a AS total FROM (
      SELECT _index, count(*) AS a, count(*) FILTER (WHERE k % 3 = 0) AS b FROM docs GROUP BY _index)
    """,
)
def ingest_delta(t: Tables) -> DataFrame:
    docs = t.docs()
    before = docs.where("network_transport = 'tcp'")
    return quality.ingest_delta(aggregates.counts_by_table(before), aggregates.counts_by_table(docs))


# Files ---------------------------------------------------------------------------------------


@F.pandas_udf(BinaryType())
def _packed(text: pd.Series, kind: pd.Series) -> pd.Series:
    def one(content: str, how: str) -> bytes:
        data = content.encode()
        if how == "zip":
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("first.log", data)
                archive.writestr("second.log", b"never read")
            return out.getvalue()
        whole = gzip.compress(data, mtime=0)
        return {"gz": whole, "cut": whole[:-9], "junk": b"no archive"}[how]

    return pd.Series([one(c, k) for c, k in zip(text, kind)])


_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'gz' WHEN 1 THEN 'zip' WHEN 2 THEN 'gz' WHEN 3 THEN 'cut' ELSE 'junk' END"


@query(
    "read_archives",
    f"""
    WITH d AS (SELECT doc_id, {_KINDS} AS kind, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, kind, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines, text FROM d)
    SELECT doc_id, kind, CASE WHEN kind IN ('gz', 'zip') THEN CASE WHEN text = '' THEN 0 ELSE len(lines) END END AS lines,
      kind IN ('cut', 'junk') AS damaged FROM l
    """,
    docs=False,
)
def read_archives(t: Tables) -> DataFrame:
    # Every document as an archive, some cut short and some none at all; the others are read all the same.
    kind = F.expr(_KINDS)
    packed = t.lines("documents").select(
        F.concat_ws(".", F.col("doc_id").cast("string"), kind, F.when(kind == "zip", "zip").otherwise(F.when(kind == "junk", "zip").otherwise("gz"))).alias("path"),
        _packed(F.coalesce("text", F.lit("")), kind).alias("content"),
    )
    parts = F.split("path", "[.]")
    rows = L.unpacked(packed).groupBy("file").agg(F.count("line").alias("lines"), F.bool_or(F.col("error").isNotNull()).alias("damaged"))
    # a file of no lines and no error has no row
    rows = packed.select("path").join(rows, F.col("path") == F.col("file"), "left")
    kind = F.element_at(parts, 2)
    return rows.select(
        F.element_at(parts, 1).cast("bigint").alias("doc_id"), kind.alias("kind"),
        F.when(kind.isin("gz", "zip"), F.coalesce("lines", F.lit(0))).cast("bigint").alias("lines"),
        F.coalesce("damaged", F.lit(False)).alias("damaged"),
    )


@query(
    "ingest_folder",
    """
    SELECT 'logs-' || CASE WHEN event_id % 3 = 0 THEN 'gz' ELSE 'plain' END AS dataset, strftime(ts, '%Y.%m.%d') AS day, count(*) AS docs
    FROM events WHERE event_id % 50 > 2 GROUP BY ALL
    """,
    docs=False,
)
def ingest_folder(t: Tables) -> DataFrame:
    # A folder of plain and packed files of many lines each: all datasets in one write and one commit.
    folder = work_dir(t.spark, "files")
    # a file is routed by its first line: lines that are no JSON at all are left out, scalars and blank ones stay
    lines = event_lines(t.lines("events")).where("event_id % 50 <> 0").withColumn("value", F.replace("value", F.lit('"timestamp"'), F.lit('"@timestamp"')))
    lines.where("event_id % 3 <> 0").select("value").repartition(12).write.text(f"{folder}/in/plain")
    lines.where("event_id % 3 = 0").select("value").repartition(6).write.option("compression", "gzip").text(f"{folder}/in/gz")
    store = Store(t.spark, f"{folder}/store")
    out = None
    for kind in ("plain", "gz"):
        report = ingest_files(store, f"{folder}/in/{kind}/part-*", Options(base=f"logs-{kind}"))
        if report.where("error is not null").count():
            raise RuntimeError("no file here is damaged")
        part = store.read(f"logs-{kind}").select(F.lit(f"logs-{kind}").alias("dataset"), F.date_format("_day", "yyyy.MM.dd").alias("day"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("dataset", "day").agg(F.count(F.lit(1)).alias("docs"))
