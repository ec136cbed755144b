"""Patches, merge on read, audit reports, rollback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.fields import from_leaf
from lanternlog.model import TS
from lanternlog.operators import aggregates, patches as P, rollback as B
from lanternlog.operators.patches import Run
from lanternlog.plans.registry import query
from lanternlog.session import work_dir
from lanternlog.sources.bind import Tables


def _run(n: int, name: str) -> Run:
    return Run(f"{name}-{n}", name, "lab", n, dt.datetime(2024, 2, 1, 0, n, tzinfo=dt.timezone.utc))


def _narrow(t: Tables) -> DataFrame:
    """Documents with the promoted columns the reports read, and all leaves."""
    return t.full_docs().select("_index", "_id", "_day", TS, "event_dataset", "alert_severity", "destination_port",
                           "network_transport", "rule_name", "fields")


def _risk(docs: DataFrame) -> DataFrame:
    score = F.when(F.col("alert_severity") == 1, 95).when(F.col("alert_severity") == 2, 70).otherwise(40)
    alerts = {"term": {"event.dataset": "suricata.alert"}}
    return P.set_patch(docs, alerts, {"risk.score": score, "risk.source": "lab"}, _run(1, "risk"))


def _lower(docs: DataFrame) -> DataFrame:
    web = {"terms": {"destination.port": [80, 443]}}
    return P.set_patch(docs, web, {"risk.score": 10}, _run(2, "lower"))


def _written(t: Tables, records: DataFrame) -> DataFrame:
    """The records as a written table, the way a store keeps the log of a run."""
    folder = work_dir(t.spark, "log")
    records.write.parquet(folder)
    return t.spark.read.schema(records.schema).parquet(folder)


def _leaf(path: str, dtype: str = "string"):
    return from_leaf(F.col("fields")[path], dtype)


@query(
    "update_by_query",
    """
    SELECT _id, CASE WHEN destination_port IN (80, 443) THEN 10 WHEN alert_severity = 1 THEN 95 WHEN alert_severity = 2 THEN 70
        WHEN event_dataset = 'suricata.alert' THEN 40 END AS score,
      CASE WHEN event_dataset = 'suricata.alert' THEN 'lab' END AS source FROM docs
    """,
)
def update_by_query(t: Tables) -> DataFrame:
    docs = _narrow(t)
    log = _written(t, _risk(docs))
    log = log.unionByName(_written(t, _lower(P.apply_patches(docs, log))))
    state = P.apply_patches(docs, log)
    return state.select("_id", _leaf("risk.score", "int").alias("score"), _leaf("risk.source").alias("source"))


@query(
    "conditional_enrich",
    """
    SELECT score, count(*) AS docs FROM (SELECT CASE alert_severity WHEN 1 THEN 95 WHEN 2 THEN 70 ELSE 40 END AS score
      FROM docs WHERE event_dataset = 'suricata.alert') GROUP BY score
    """,
)
def conditional_enrich(t: Tables) -> DataFrame:
    docs = _narrow(t)
    state = P.apply_patches(docs, _risk(docs))
    scored = state.where(F.map_contains_key("fields", "risk.score"))
    return scored.groupBy(_leaf("risk.score", "int").alias("score")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "patched_filter",
    "SELECT _id FROM docs WHERE event_dataset = 'suricata.alert' AND alert_severity = 1",
)
def patched_filter(t: Tables) -> DataFrame:
    # Filters see patched values, here through the leaf map.
    from lanternlog.functions.predicates import where

    docs = _narrow(t)
    state = P.apply_patches(docs, _risk(docs))
    return where(state, {"range": {"risk.score": {"gte": 90}}}).select("_id")


@query(
    "remove_by_query",
    """
    SELECT _id, CASE WHEN network_transport <> 'udp' THEN network_transport END AS transport,
      CASE WHEN network_transport <> 'udp' THEN rule_name END AS rule,
      network_transport <> 'udp' AS has_packets FROM docs
    """,
)
def remove_by_query(t: Tables) -> DataFrame:
    docs = _narrow(t)
    udp = {"term": {"network.transport": "udp"}}
    # A whole object and a field that is mostly absent.
    log = P.remove_patch(docs, udp, ["network", "rule.name"], _run(1, "strip"))
    state = P.apply_patches(docs, log)
    return state.select(
        "_id", F.col("network_transport").alias("transport"), F.col("rule_name").alias("rule"),
        F.map_contains_key("fields", "network.packets").alias("has_packets"),
    )


@query(
    "replace_scalar_parent",
    """
    SELECT _id, CASE WHEN alert_severity <> 2 THEN alert_severity END AS severity,
      CASE WHEN alert_severity = 2 THEN 'two' END AS word, CASE WHEN alert_severity = 1 THEN 7 END AS nested
    FROM docs WHERE event_dataset = 'suricata.alert'
    """,
)
def replace_scalar_parent(t: Tables) -> DataFrame:
    docs = _narrow(t).where(F.col("event_dataset") == "suricata.alert")
    log = P.set_patch(docs, {"term": {"alert.severity": 2}}, {"alert.severity.word": "two"}, _run(1, "word"))
    log = log.unionByName(
        P.set_patch(docs, {"term": {"alert.severity": 1}}, {"extra": {"a": {"b": 7}, "c": [1, 2]}}, _run(2, "object"))
    )
    state = P.apply_patches(docs, log)
    return state.select(
        "_id", F.col("alert_severity").alias("severity"), _leaf("alert.severity.word").alias("word"),
        _leaf("extra.a.b", "int").alias("nested"),
    )


@query(
    "view_update",
    """
    SELECT _index, count(*) AS flagged FROM alerts GROUP BY _index
    """,
)
def view_update(t: Tables) -> DataFrame:
    # A view is a target: every document is changed in its own table.
    from lanternlog.plans.catalog import catalog_of

    catalog = catalog_of(t, full=True)
    log = P.set_patch(catalog.read("soc-alerts"), None, {"seen": True}, _run(1, "seen"))
    state = P.apply_patches(_narrow(t), log)
    return state.where(_leaf("seen") == "true").groupBy("_index").agg(F.count(F.lit(1)).alias("flagged"))


@query("dry_run", "SELECT count(*) AS would_update FROM docs WHERE event_dataset = 'suricata.alert'")
def dry_run(t: Tables) -> DataFrame:
    return _risk(_narrow(t)).agg(F.count(F.lit(1)).alias("would_update"))


@query(
    "audit_records",
    """
    SELECT _id AS doc_id, _index AS index, 'lower-2' AS run_id, 'update_doc' AS operation, 'risk.score' AS changed,
      event_dataset = 'suricata.alert' AS existed, CASE WHEN event_dataset = 'suricata.alert' THEN
        CASE alert_severity WHEN 1 THEN '95' WHEN 2 THEN '70' ELSE '40' END END AS before, '10' AS after
    FROM docs WHERE destination_port IN (80, 443)
    """,
)
def audit_records(t: Tables) -> DataFrame:
    docs = _narrow(t)
    log = _lower(P.apply_patches(docs, _written(t, _risk(docs))))
    return log.select(
        "doc_id", "index", "run_id", "operation", F.array_join("changed_fields", ",").alias("changed"),
        F.col("before")["risk.score"]["exists"].alias("existed"), F.col("before")["risk.score"]["value"].alias("before"),
        F.col("after")["risk.score"].alias("after"),
    )


@query(
    "run_summary",
    """
    SELECT 'risk-1' AS run_id, 'risk' AS enrichment, 'lab' AS cluster, false AS dry_run, CAST(0 AS BIGINT) AS docs_created,
      count(*) AS docs_updated, CAST(0 AS BIGINT) AS docs_deleted FROM docs WHERE event_dataset = 'suricata.alert'
    """,
)
def run_summary(t: Tables) -> DataFrame:
    docs = _narrow(t)
    log = _risk(docs).unionByName(_lower(docs))
    return P.run_summary(log, _run(1, "risk"))


@query(
    "delete_documents",
    "SELECT event_dataset, count(*) AS docs FROM docs WHERE network_transport <> 'icmp' GROUP BY 1",
)
def delete_documents(t: Tables) -> DataFrame:
    docs = _narrow(t)
    log = P.delete_patch(docs, {"term": {"network.transport": "icmp"}}, _run(1, "purge"))
    log = log.unionByName(_lower(docs))
    state = P.apply_patches(docs, log)
    return state.groupBy("event_dataset").agg(F.count(F.lit(1)).alias("docs"))


# Audit records derived from line items: many runs over few documents, many ties in time. ----

_AUDIT_SQL = """
audit AS (SELECT 'run-' || CAST(l_suppkey AS VARCHAR) AS run_id, l_suppkey AS run_seq, l_orderkey * 10 + l_linenumber AS op_seq,
  epoch_ms(l_shipdate) AS ts_ms, CASE WHEN l_quantity < 20 THEN 'geo' WHEN l_quantity < 40 THEN 'risk' ELSE 'owner' END AS enrichment,
  CASE WHEN l_suppkey % 3 = 0 THEN 'lab' ELSE 'remote' END AS cluster,
  'idx-' || l_returnflag AS index, CAST(l_partkey % 400 AS VARCHAR) AS doc_id, l_linestatus = 'F' AS supported,
  'field' || CAST(l_linenumber AS VARCHAR) AS field, CASE WHEN l_linenumber < 3 THEN 'field0' END AS field2 FROM lineitem)
"""


def _audit(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    fields = F.array(F.concat(F.lit("field"), number.cast("string")), F.when(number < 3, "field0"))
    quantity = F.col("l_quantity")
    return t.table("lineitem").select(
        F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("run_id"),
        F.col("l_suppkey").alias("run_seq"),
        (F.col("l_orderkey") * 10 + number).alias("op_seq"),
        F.col("l_shipdate").alias(TS),
        F.when(quantity < 20, "geo").when(quantity < 40, "risk").otherwise("owner").alias("enrichment"),
        F.when(F.col("l_suppkey") % 3 == 0, "lab").otherwise("remote").alias("cluster"),
        F.concat(F.lit("idx-"), "l_returnflag").alias("index"),
        (F.col("l_partkey") % 400).cast("string").alias("doc_id"),
        F.lit(None).cast("date").alias("doc_day"),
        F.lit("update_doc").alias("operation"),
        F.filter(fields, lambda f: f.isNotNull()).alias("changed_fields"),
        (F.col("l_linestatus") == "F").alias("rollback_supported"),
        F.lit(None).cast("string").alias("reverts_run_id"),
    )


@query(
    "run_list",
    "WITH "
    + _AUDIT_SQL.strip()
    + """
    , e AS (SELECT run_id, arg_min(enrichment, (-n, enrichment)) AS enrichment FROM (SELECT run_id, enrichment, count(*) AS n FROM audit GROUP BY ALL) GROUP BY 1)
    SELECT run_id, max(ts_ms) AS latest_ms, any_value(e.enrichment) AS enrichment, any_value(cluster) AS cluster, count(*) AS operations
    FROM audit JOIN e USING (run_id) GROUP BY run_id ORDER BY 2 DESC, 1 LIMIT 50
    """,
    docs=False,
)
def run_list(t: Tables) -> DataFrame:
    runs = aggregates.run_list(_audit(t), 50)
    return runs.select("run_id", F.unix_millis("latest").alias("latest_ms"), "enrichment", "cluster", "operations")


@query(
    "run_totals",
    "WITH " + _AUDIT_SQL.strip() + " SELECT count(DISTINCT run_id) AS runs, count(*) AS operations FROM audit",
    docs=False,
)
def run_totals(t: Tables) -> DataFrame:
    return aggregates.run_totals(_audit(t))


_LATER_SQL = (
    "WITH "
    + _AUDIT_SQL.strip()
    + """
, c AS (SELECT run_id, run_seq, op_seq, ts_ms, cluster, index, doc_id, unnest([field, field2]) AS f FROM audit WHERE supported),
m AS (SELECT cluster, index, doc_id, f, run_id, max(ts_ms) AS ts_ms FROM c WHERE f IS NOT NULL GROUP BY ALL),
later AS (SELECT DISTINCT c.run_id, c.run_seq, c.op_seq, c.cluster, c.index, c.doc_id FROM c JOIN m ON c.cluster = m.cluster
  AND c.index = m.index AND c.doc_id = m.doc_id AND c.f = m.f AND c.run_id <> m.run_id AND m.ts_ms > c.ts_ms)
"""
)


@query("later_changes", _LATER_SQL + "SELECT * FROM later", docs=False)
def later_changes(t: Tables) -> DataFrame:
    return B.later_changes(_audit(t)).drop("fields")


@query(
    "rollback_plan",
    _LATER_SQL
    + """
    SELECT a.op_seq, a.cluster, a.index, a.doc_id, 'update_doc' AS operation, EXISTS (SELECT 1 FROM later l WHERE l.run_id = a.run_id
      AND l.op_seq = a.op_seq AND l.index = a.index AND l.doc_id = a.doc_id AND l.cluster = a.cluster) AS blocked
    FROM audit a WHERE a.run_id = 'run-7' AND supported
    """,
    docs=False,
)
def rollback_plan(t: Tables) -> DataFrame:
    return B.rollback_plan(_audit(t), "run-7").drop("doc_day")


@query(
    "read_run",
    "WITH " + _AUDIT_SQL.strip() + " SELECT op_seq, index, doc_id, ts_ms FROM audit WHERE run_id = 'run-3'",
    docs=False,
)
def read_run(t: Tables) -> DataFrame:
    return P.read_run(_audit(t), "run-3").select("op_seq", "index", "doc_id", F.unix_millis(TS).alias("ts_ms"))


@query(
    "rollback_state",
    """
    SELECT _id, CASE WHEN event_dataset = 'suricata.alert' THEN CASE alert_severity WHEN 1 THEN 95 WHEN 2 THEN 70 ELSE 40 END END AS score,
      network_transport AS transport, CASE WHEN destination_port IN (80, 443) THEN 1 ELSE 0 END AS touched FROM docs
    """,
)
def rollback_state(t: Tables) -> DataFrame:
    # A run that sets, removes and overwrites is undone; the run before it stays.
    docs = _narrow(t)
    log = _written(t, _risk(docs))
    second = _run(2, "lower")
    web = {"terms": {"destination.port": [80, 443]}}
    steps = [
        lambda d: P.set_patch(d, web, {"risk.score": 10, "note": "x"}, second, 1),
        lambda d: P.remove_patch(d, web, ["network", "absent.path"], second, 2),
    ]
    for step in steps:
        log = log.unionByName(_written(t, step(P.apply_patches(docs, log))))
    log = log.unionByName(B.compensation(log, "lower-2", _run(3, "rollback")))
    state = P.apply_patches(docs, log)
    touched = F.col("destination_port").isin(80, 443) & ~F.map_contains_key("fields", "note")
    return state.select(
        "_id", _leaf("risk.score", "int").alias("score"), F.col("network_transport").alias("transport"),
        touched.cast("int").alias("touched"),
    )


@query(
    "rollback_result",
    "WITH " + _AUDIT_SQL.strip() + " SELECT count(*) FILTER (WHERE supported) AS reverted, count(*) AS total FROM audit WHERE run_id = 'run-7'",
    docs=False,
)
def rollback_result(t: Tables) -> DataFrame:
    return B.rollback_result(_audit(t), "run-7")
