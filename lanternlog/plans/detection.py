"""Standing rules in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.model import TS
from lanternlog.operators import detect as D
from lanternlog.operators.suppress import Limits, suppress
from lanternlog.plans.registry import millis, query
from lanternlog.session import work_dir
from lanternlog.sources.bind import _EVENTS, DOCS_SQL, Tables, event_documents, event_lines
from lanternlog.streaming import detect as SD, ingest as SI

RULES = [
    D.Rule("critical", {"term": {"alert.severity": 1}}),
    D.Rule("ssh-out", {"bool": {"must": [{"term": {"destination.port": 22}}, {"cidr": {"destination.ip": "203.0.113.0/24"}}]}},
           query_key="source.ip"),
    D.Rule("first-week-dns", {"term": {"event.dataset": "suricata.dns"}}, table="suricata-2024.01.0*", query_key="rule.name"),
    D.Rule("broken", {"nonsense": {}}),
]

_HITS_SQL = """
hits AS (
  SELECT 'critical' AS rule_id, CAST(flow_id AS VARCHAR) AS query_key, _id AS event_id, ts, ts_ms FROM docs WHERE alert_severity = 1
  UNION ALL SELECT 'ssh-out', source_ip, _id, ts, ts_ms FROM docs WHERE destination_port = 22 AND destination_ip LIKE '203.0.113.%'
  UNION ALL SELECT 'first-week-dns', rule_name, _id, ts, ts_ms FROM docs WHERE event_dataset = 'suricata.dns' AND _index LIKE 'suricata-2024.01.0%')
"""


@query(
    "detect_batch",
    "WITH " + _HITS_SQL.strip() + " SELECT rule_id, query_key, event_id, ts_ms FROM hits",
)
def detect_batch(t: Tables) -> DataFrame:
    hits = D.detect(t.docs(), RULES, t.now())
    return hits.select("rule_id", "query_key", "event_id", millis())


@query(
    "detect_timestamps",
    """
    SELECT 'critical/' || _index || '/' || _id AS _id, CASE WHEN k % 3 = 0 THEN (SELECT max(ts_ms) FROM docs) ELSE ts_ms END AS ts_ms,
      (SELECT max(ts_ms) FROM docs) AS alert_ms FROM docs WHERE alert_severity = 1
    """,
)
def detect_timestamps(t: Tables) -> DataFrame:
    # An event without a time gives the alert its own time.
    docs = t.docs().withColumn(TS, F.when(F.col("network_transport") != "tcp", F.col(TS)))
    hits = D.detect(docs, RULES[:1], t.now())
    return hits.select("_id", millis(), F.unix_millis("alert_time").alias("alert_ms"))


@query("rule_errors", "SELECT 'broken' AS rule_id, (SELECT max(ts_ms) FROM docs) AS ts_ms")
def rule_errors(t: Tables) -> DataFrame:
    docs = t.docs()
    return D.rule_errors(docs, D.prepare(docs, RULES), t.now()).select("rule_id", millis())


@query("look_back", "SELECT _id FROM docs WHERE ts >= (SELECT max(ts) FROM docs) - INTERVAL 7 DAY")
def look_back(t: Tables) -> DataFrame:
    return D.look_back(t.docs(), t.now(), 7).select("_id")


def _dedup_sql(key: str) -> str:
    return f"""
WITH RECURSIVE {DOCS_SQL.strip()},
h AS (SELECT {key} AS key, epoch_us(ts) AS us, arg_min(_id, (_index, _id)) AS event_id FROM docs
  WHERE event_dataset = 'suricata.alert' GROUP BY ALL),
kept AS (
  SELECT key, min(us) AS us FROM h GROUP BY key
  UNION ALL
  SELECT kept.key, min(h.us) AS us FROM kept JOIN h ON h.key = kept.key AND h.us >= kept.us + 3600000000 GROUP BY kept.key
)
SELECT h.event_id, h.us // 1000 AS ts_ms FROM kept JOIN h USING (key, us)
"""


def _alert_hits(t: Tables, key: str) -> DataFrame:
    return D.detect(t.docs(), [D.Rule("any", {"term": {"event.dataset": "suricata.alert"}}, query_key=key)], t.now())


@query("detect_dedup", _dedup_sql("flow_id"), docs=False)
def detect_dedup(t: Tables) -> DataFrame:
    return suppress(_alert_hits(t, "flow_id"), 3600).select("event_id", millis())


@query("detect_dedup_hot", _dedup_sql("event_dataset"), docs=False)
def detect_dedup_hot(t: Tables) -> DataFrame:
    # One key for everything, cut into small chunks: the path a hot key takes.
    hits = _alert_hits(t, "event.dataset")
    return suppress(hits, 3600, limits=Limits(hot=200, chunk=100, fan=4)).select("event_id", millis())


_MANY = 5000


@query(
    "detect_many_rules",
    """
    SELECT CASE WHEN n % 3 = 0 THEN 'user-' || CAST(n AS VARCHAR) ELSE 'alert-of-' || CAST(n AS VARCHAR) END AS rule_id, count(*) AS hits
    FROM (SELECT flow_id AS n, event_dataset, network_transport FROM docs)
    WHERE n < 5000 AND (n % 3 = 0 OR event_dataset = 'suricata.alert' AND network_transport IN ('tcp', 'udp')) GROUP BY ALL
    UNION ALL SELECT 'large', count(*) FROM docs WHERE flow_bytes_toserver > 50000 HAVING count(*) > 0
    """,
)
def detect_many_rules(t: Tables) -> DataFrame:
    # Thousands of rules on values, found by value, beside one that has to be tried.
    rules = []
    for n in range(_MANY):
        user = {"term": {"flow_id": n}}
        loud = {"bool": {"must": [{"term": {"event.dataset": "suricata.alert"}}, user], "filter": {"terms": {"network.transport": ["tcp", "udp"]}}}}
        rules.append(D.Rule(f"user-{n}", user) if n % 3 == 0 else D.Rule(f"alert-of-{n}", loud, table="suricata-*"))
    rules.append(D.Rule("large", {"range": {"flow.bytes_toserver": {"gt": 50000}}}))
    return D.detect(t.docs(), rules, t.now()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "detect_dedup_long_window",
    """
    SELECT arg_min(_id, (ts, _index, _id)) AS event_id, min(ts_ms) AS ts_ms FROM docs WHERE event_dataset = 'suricata.alert'
    """,
)
def detect_dedup_long_window(t: Tables) -> DataFrame:
    # One key, a window longer than the data, small chunks: only the first hit stays.
    hits = _alert_hits(t, "event.dataset")
    return suppress(hits, 20 * 365 * 86400, limits=Limits(hot=100, chunk=50, fan=4)).select("event_id", millis())


@query(
    "detect_dedup_short_window",
    """
    SELECT event_id, ts_ms FROM (SELECT arg_min(_id, (_index, _id)) AS event_id, epoch_us(ts) AS us, min(ts_ms) AS ts_ms,
      lag(epoch_us(ts)) OVER (ORDER BY epoch_us(ts)) AS before FROM docs WHERE event_dataset = 'suricata.alert' GROUP BY ts)
    WHERE before IS NULL OR us > before
    """,
)
def detect_dedup_short_window(t: Tables) -> DataFrame:
    # One key and a window shorter than any gap between its hits.
    hits = _alert_hits(t, "event.dataset").withColumn(TS, F.col(TS))
    return suppress(hits, 1, limits=Limits(hot=100, chunk=50, fan=4)).select("event_id", millis())


# Streams: run to the end of the given data, then read what was written. ---------------------


def _event_stream(t: Tables) -> DataFrame:
    reader = t.spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet")
    return event_documents(reader.parquet(t.sf_dir))


@query(
    "detect_stream",
    "WITH " + _HITS_SQL.strip() + " SELECT rule_id, query_key, event_id, ts_ms FROM hits",
)
def detect_stream(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "detect")
    alerts = SD.alerts_of(_event_stream(t), RULES)
    running = SD.write_alerts(alerts, f"{folder}/alerts", f"{folder}/offsets").trigger(availableNow=True).start()
    running.awaitTermination()
    written = t.spark.read.schema(alerts.schema).parquet(f"{folder}/alerts")
    return written.select("rule_id", "query_key", "event_id", millis())


@query("detect_dedup_stream", _dedup_sql("flow_id"), docs=False)
def detect_dedup_stream(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "suppress")
    rule = D.Rule("any", {"term": {"event.dataset": "suricata.alert"}})
    alerts = SD.alerts_of(_event_stream(t), [rule])
    running = SD.write_suppressed(alerts, folder, f"{folder}/offsets", 3600).trigger(availableNow=True).start()
    running.awaitTermination()
    return SD.read_alerts(t.spark, folder, alerts.schema).select("event_id", millis())


@query(
    "chunk_ingest",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, 'suricata.' || event_type AS event_dataset, count(*) AS docs FROM events
    WHERE event_id % 50 > 2 GROUP BY ALL
    """,
    docs=False,
)
def chunk_ingest(t: Tables) -> DataFrame:
    folder = work_dir(t.spark, "chunks")
    event_lines(t.table("events")).repartition(4).select("value").write.text(f"{folder}/in")
    chunks = SI.stream_chunks(t.spark, f"{folder}/in", files_per_batch=2, pattern="*.txt")
    running = SI.land(chunks, "suricata", folder, f"{folder}/offsets").trigger(availableNow=True).start()
    running.awaitTermination()
    landed = SI.landed(t.spark, folder)
    day = F.date_format("_day", "yyyy-MM-dd").alias("day")
    return landed.groupBy(day, "event_dataset").agg(F.count(F.lit(1)).alias("docs"))
