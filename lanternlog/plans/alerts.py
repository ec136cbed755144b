"""Feeds, timeline, statistics, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions import projections as P
from lanternlog.functions.predicates import compile_filter, where
from lanternlog.model import ALERT_VIEW_FILTER, SUPPRESSED_SIDS, TS
from lanternlog.operators import aggregates as A, detect, feeds
from lanternlog.plans.registry import millis, query
from lanternlog.sources.bind import Tables


def alerts_of(t: Tables) -> DataFrame:
    return where(t.docs(), ALERT_VIEW_FILTER)


def flows_of(t: Tables) -> DataFrame:
    return where(t.docs(), {"term": {"event.dataset": "suricata.flow"}})


@query(
    "alerts_feed",
    """
    SELECT _index, _id, ts_ms, alert_signature, alert_severity, alert_category, alert_action, source_ip,
      destination_ip, destination_port, network_transport, event_dataset, rule_name,
      CASE WHEN tagged_alert THEN 'suricata,alert' ELSE 'suricata' END AS tags,
      (SELECT count(*) FROM alerts WHERE alert_severity = 2) AS total
    FROM alerts WHERE alert_severity = 2 ORDER BY ts DESC, _index, _id LIMIT 100 OFFSET 20
    """,
)
def alerts_feed(t: Tables) -> DataFrame:
    page = feeds.alert_feed(alerts_of(t), size=100, severity="high", offset=20)
    total = feeds.total(alerts_of(t), feeds.alert_filter("high")).scalar()
    return page.select(
        "_index", "_id", millis(), "alert_signature", "alert_severity", "alert_category", "alert_action", "source_ip",
        "destination_ip", "destination_port", "network_transport", "event_dataset", "rule_name",
        F.concat_ws(",", "tags").alias("tags"), total.alias("total"),
    )


@query(
    "alerts_feed_search",
    """
    SELECT _id, ts_ms, alert_severity FROM alerts
    WHERE event_dataset = 'suricata.alert' AND regexp_matches(lower(message), '(^|[^a-z0-9_])error([^a-z0-9_]|$)')
      AND regexp_matches(lower(message), '(^|[^a-z0-9_])7([^a-z0-9_]|$)')
    ORDER BY ts DESC, _index, _id LIMIT 500
    """,
)
def alerts_feed_search(t: Tables) -> DataFrame:
    # An unknown severity name filters nothing; both words must occur.
    found = where(
        alerts_of(t), {"search": {"query": "Error 7", "operator": "and", "fields": ["message"]}}
    )
    page = feeds.alert_feed(found, size=500, severity="unheard-of", dataset="suricata.alert")
    return page.select("_id", millis(), "alert_severity")


@query(
    "alerts_timeline",
    """
    WITH n AS (SELECT max(ts_ms) AS now_ms FROM docs),
    c AS (SELECT ts_ms // 21600000 AS b, count(*) AS n FROM alerts, n WHERE ts_ms >= now_ms - 259200000 GROUP BY 1),
    s AS (SELECT unnest(range(now_ms // 21600000 - 11, now_ms // 21600000 + 1)) AS b FROM n)
    SELECT s.b * 21600000 AS bucket_ms, coalesce(c.n, 0) AS count FROM s LEFT JOIN c USING (b)
    """,
)
def alerts_timeline(t: Tables) -> DataFrame:
    return A.timeline(alerts_of(t), t.now(), minutes=3 * 24 * 60, buckets=12)


@query(
    "alerts_timeline_severity",
    """
    WITH n AS (SELECT max(ts_ms) AS now_ms FROM docs),
    c AS (SELECT ts_ms // 3600000 AS b, count(*) AS n FROM alerts, n
      WHERE ts_ms >= now_ms - 172800000 AND alert_severity = 1 GROUP BY 1),
    s AS (SELECT unnest(range(now_ms // 3600000 - 47, now_ms // 3600000 + 1)) AS b FROM n),
    f AS (SELECT s.b * 3600000 AS bucket_ms, coalesce(c.n, 0) AS count FROM s LEFT JOIN c USING (b))
    SELECT bucket_ms, count,
      CAST(greatest(4, floor(count / greatest((SELECT max(count) FROM f), 1) * 100)) AS INTEGER) AS height FROM f
    """,
)
def alerts_timeline_severity(t: Tables) -> DataFrame:
    critical = where(alerts_of(t), {"term": {"alert.severity": 1}})
    bars = A.timeline(critical, t.now(), minutes=48 * 60, buckets=48)
    return bars.withColumn("height", P.bar_height(F.col("count")))


@query(
    "alerts_stats",
    """
    SELECT 'total' AS facet, 'all' AS key, count(*) AS count FROM alerts
    UNION ALL
    SELECT * FROM (SELECT 'severity', CASE alert_severity WHEN 1 THEN 'critical' WHEN 2 THEN 'high'
      WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE CAST(alert_severity AS VARCHAR) END, count(*)
      FROM alerts WHERE alert_severity IS NOT NULL GROUP BY alert_severity ORDER BY 3 DESC, alert_severity LIMIT 10)
    UNION ALL
    SELECT * FROM (SELECT 'dataset', event_dataset, count(*) FROM alerts GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    """,
)
def alerts_stats(t: Tables) -> DataFrame:
    return A.alert_stats(alerts_of(t))


@query(
    "tag_facet",
    """
    SELECT key, count(*) AS count FROM (
      SELECT 'suricata' AS key FROM docs UNION ALL SELECT 'alert' FROM docs WHERE tagged_alert) GROUP BY key
    """,
)
def tag_facet(t: Tables) -> DataFrame:
    return A.top_values(t.docs(), "tags")


@query(
    "flows_feed",
    """
    SELECT _id, ts_ms, source_ip || CASE WHEN source_port <> 0 THEN ':' || CAST(source_port AS VARCHAR) ELSE '' END AS source,
      destination_ip || ':' || CAST(destination_port AS VARCHAR) AS destination, network_transport, network_packets,
      event_duration, flow_pkts_toserver, flow_pkts_toclient,
      CASE WHEN network_bytes <> 0 THEN network_bytes
        WHEN flow_bytes_toserver <> 0 THEN flow_bytes_toserver + coalesce(flow_bytes_toclient, 0) END AS bytes
    FROM docs WHERE event_dataset = 'suricata.flow' AND network_transport = 'udp'
    ORDER BY ts DESC, _index, _id LIMIT 200
    """,
)
def flows_feed(t: Tables) -> DataFrame:
    page = feeds.flow_feed(t.docs(), size=200, proto="UDP")
    return page.select(
        "_id", millis(), P.endpoint(F.col("source_ip"), F.col("source_port")).alias("source"),
        P.endpoint(F.col("destination_ip"), F.col("destination_port")).alias("destination"),
        "network_transport", "network_packets", "event_duration", "flow_pkts_toserver", "flow_pkts_toclient",
        P.flow_bytes(F.col("network_bytes"), F.col("flow_bytes_toserver"), F.col("flow_bytes_toclient")).alias("bytes"),
    )


@query(
    "flows_feed_search",
    """
    SELECT _id, ts_ms FROM docs WHERE event_dataset = 'suricata.flow'
      AND (regexp_matches(destination_ip, '(^|[^a-z0-9_])203\\.0\\.113\\.9([^a-z0-9_]|$)')
        OR regexp_matches(network_transport, '(^|[^a-z0-9_])icmp([^a-z0-9_]|$)'))
    ORDER BY ts DESC, _index, _id LIMIT 300
    """,
)
def flows_feed_search(t: Tables) -> DataFrame:
    # Any word is enough for flows.
    wanted = {"search": {"query": "203.0.113.9 icmp", "operator": "or", "fields": ["destination.ip", "network.transport"]}}
    return feeds.flow_feed(where(t.docs(), wanted), size=300).select("_id", millis())


@query(
    "flow_facets",
    """
    SELECT count(DISTINCT source_ip) AS unique_src, count(DISTINCT destination_ip) AS unique_dst,
      (SELECT count(*) FROM docs WHERE event_dataset = 'suricata.flow' AND network_transport = 'tcp') AS total
    FROM docs WHERE event_dataset = 'suricata.flow'
    """,
)
def flow_facets(t: Tables) -> DataFrame:
    # Facets ignore the filter, the total obeys it.
    total = feeds.total(t.docs(), feeds.flow_filter(proto="tcp")).scalar()
    return A.flow_facets(flows_of(t), exact=True).withColumn("total", total)


@query("flow_facets_approx", "SELECT true AS src_close, true AS dst_close", docs=False)
def flow_facets_approx(t: Tables) -> DataFrame:
    """Are the sketches within 5 % of the exact counts?"""
    exact = A.flow_facets(flows_of(t), exact=True)
    near = lambda c: F.abs(F.col(c) - exact.select(c).scalar()) <= 0.05 * exact.select(c).scalar()
    return A.flow_facets(flows_of(t)).select(near("unique_src").alias("src_close"), near("unique_dst").alias("dst_close"))


@query(
    "flow_transports",
    """
    SELECT network_transport AS key, count(*) AS count FROM docs WHERE event_dataset = 'suricata.flow'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
def flow_transports(t: Tables) -> DataFrame:
    return A.top_values(flows_of(t), "network_transport")


@query(
    "top_protocol",
    """
    SELECT network_transport AS top_protocol FROM docs WHERE event_dataset = 'suricata.flow'
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
    """,
)
def top_protocol(t: Tables) -> DataFrame:
    return A.top_protocol(flows_of(t))


@query(
    "overview",
    """
    SELECT count(*) AS docs, count(DISTINCT _index) AS tables,
      count(*) FILTER (WHERE event_dataset IN ('alert', 'suricata.alert') OR tagged_alert) AS alerts,
      count(*) FILTER (WHERE alert_severity = 1) AS critical,
      CASE WHEN count(*) FILTER (WHERE alert_severity = 1) > 0 THEN 'red' ELSE 'amber' END AS status
    FROM docs
    """,
)
def overview(t: Tables) -> DataFrame:
    docs = t.docs()
    return A.overview(docs, compile_filter(docs, ALERT_VIEW_FILTER))


@query(
    "recent_alerts",
    """
    SELECT _id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown,
      coalesce(CASE alert_severity WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' END, 'info') AS severity,
      coalesce(nullif(alert_signature, ''), nullif(rule_name, ''), '—') AS signature
    FROM alerts ORDER BY ts DESC, _index, _id LIMIT 3
    """,
)
def recent_alerts(t: Tables) -> DataFrame:
    return A.recent(alerts_of(t), 3, "_index", "_id").select(
        "_id",
        P.timestamp_text(F.col(TS)).alias("shown"),
        P.severity_label(F.col("alert_severity"), keep_text=False).alias("severity"),
        P.first_filled(F.col("alert_signature"), F.col("rule_name")).alias("signature"),
    )


@query(
    "sorted_search",
    """
    SELECT _id, network_packets, ts_ms FROM docs WHERE event_dataset = 'suricata.dns'
    ORDER BY network_packets DESC, ts, _index, _id LIMIT 150
    """,
)
def sorted_search(t: Tables) -> DataFrame:
    found = feeds.search(
        t.docs(), {"term": {"event.dataset": "suricata.dns"}}, 150, [{"network.packets": "desc"}, {TS: {"order": "asc"}}]
    )
    return found.select("_id", "network_packets", millis())


@query("scan_all", "SELECT _id, event_dataset FROM docs WHERE network_transport = 'icmp'")
def scan_all(t: Tables) -> DataFrame:
    return feeds.scan(t.docs(), {"term": {"network.transport": "icmp"}}).select("_id", "event_dataset")


@query("document_by_id", "SELECT _index, _id, event_dataset, message FROM docs WHERE _index = 'suricata-2024.01.01' AND _id = '3'")
def document_by_id(t: Tables) -> DataFrame:
    return feeds.get(t.docs(), "suricata-2024.01.01", "3").select("_index", "_id", "event_dataset", "message")


@query(
    "severity_labels",
    """
    SELECT _id, CASE WHEN s IS NULL OR s = '' THEN 'info' WHEN s = '1' THEN 'critical' WHEN s = '2' THEN 'high'
        WHEN s = '3' THEN 'medium' WHEN s = '4' THEN 'low' WHEN TRY_CAST(s AS INTEGER) IS NOT NULL THEN 'info'
        ELSE lower(s) END AS label,
      CASE s WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS card
    FROM (SELECT _id, CASE WHEN k < 70 THEN CAST(k % 7 AS VARCHAR) WHEN k < 80 THEN 'High' WHEN k < 90 THEN '' END AS s FROM docs)
    """,
)
def severity_labels(t: Tables) -> DataFrame:
    k = F.col("alert_k")
    raw = F.when(k < 70, (k % 7).cast("string")).when(k < 80, "High").when(k < 90, "")
    docs = t.docs().withColumn("alert_k", F.regexp_extract("message", "k=([0-9]+)", 1).cast("bigint"))
    return docs.select(
        "_id", P.severity_label(raw).alias("label"), P.severity_label(raw, keep_text=False).alias("card")
    )


@query(
    "bytes_human",
    """
    SELECT n, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN CAST(n // 1024 AS VARCHAR) || ' KB'
      WHEN n < 1073741824 THEN CAST(n // 1048576 AS VARCHAR) || ' MB' WHEN n < 1099511627776 THEN CAST(n // 1073741824 AS VARCHAR) || ' GB'
      ELSE CAST(n // 1099511627776 AS VARCHAR) || ' GB' END AS shown
    FROM (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000
      WHEN 2 THEN 1000000 WHEN 3 THEN 100000000 ELSE 0 END AS n FROM orders)
    """,
    docs=False,
)
def bytes_human(t: Tables) -> DataFrame:
    scale = F.element_at(
        F.array(*[F.lit(x).cast("bigint") for x in (1, 1000, 1_000_000, 100_000_000, 0)]),
        (F.col("o_orderkey") % 5 + 1).cast("int"),
    )
    sizes = t.table("orders").select((F.floor("o_totalprice") * scale).alias("n")).distinct()
    return sizes.select("n", P.bytes_floor(F.col("n")).alias("shown"))


@query(
    "file_sizes",
    """
    SELECT source, bytes, CASE WHEN bytes < 1024 THEN CAST(bytes AS VARCHAR) || ' B'
      WHEN bytes < 1048576 THEN CAST(CAST(round_even(bytes / 1024, 0) AS BIGINT) AS VARCHAR) || ' KB'
      ELSE CAST(CAST(round_even(bytes / 1048576, 0) AS BIGINT) AS VARCHAR) || ' MB' END AS shown
    FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source)
    """,
    docs=False,
)
def file_sizes(t: Tables) -> DataFrame:
    sizes = t.table("documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    return sizes.withColumn("shown", P.bytes_decimal(F.col("bytes")))


@query(
    "suppress_signatures",
    """
    SELECT _id, alert_signature_id FROM alerts
    WHERE alert_signature_id IS NULL OR alert_signature_id NOT IN
      (2200073, 2200074, 2200075, 2200076, 2200077, 2200078, 2200079, 2200121)
    """,
)
def suppress_signatures(t: Tables) -> DataFrame:
    return detect.unsuppressed(alerts_of(t), SUPPRESSED_SIDS).select("_id", "alert_signature_id")


@query("count_by_table", "SELECT _index, count(*) AS docs FROM docs GROUP BY _index")
def count_by_table(t: Tables) -> DataFrame:
    return A.counts_by_table(t.docs())
