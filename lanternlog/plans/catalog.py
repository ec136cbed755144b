"""Views, rule text and source inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.projections import keyword_category, vendor_name
from lanternlog.model import ALERT_VIEW_FILTER, VENDOR_KEYWORDS, VENDOR_PREFIXES
from lanternlog.operators import aggregates, detect as D, rules as R, views as V
from lanternlog.plans.registry import millis, query
from lanternlog.sources.bind import RULES_SQL, Tables, rule_lines


def catalog_of(t: Tables, detections: DataFrame | None = None, full: bool = False) -> V.Catalog:
    """Event documents as one dated dataset, and detections when given.

    The physical tables are the days the data has: a handful of names, read once.
    """
    docs = t.full_docs() if full else t.docs()
    catalog = V.Catalog()
    names = [r[0] for r in docs.select("_index").distinct().collect()]  # one name per day
    catalog.register("suricata", lambda: docs, lambda: sorted(names))
    if detections is not None:
        catalog.register(V.DETECTIONS, lambda: detections, lambda: [V.DETECTIONS])
    return catalog


def _hits(t: Tables) -> DataFrame:
    rule = D.Rule("dns-critical", {"bool": {"must": [{"term": {"alert.severity": 1}}]}})
    return D.detect(t.docs(), [rule], t.now())


@query(
    "view_soc_alerts",
    """
    SELECT _index, _id, ts_ms, event_dataset FROM alerts
    UNION ALL SELECT 'detections', 'dns-critical/' || _index || '/' || _id, ts_ms, NULL FROM docs WHERE alert_severity = 1
    """,
)
def view_soc_alerts(t: Tables) -> DataFrame:
    return catalog_of(t, _hits(t)).read("soc-alerts").select("_index", "_id", millis(), "event_dataset")


@query("view_suricata", "SELECT event_dataset, count(*) AS docs FROM docs GROUP BY 1")
def view_suricata(t: Tables) -> DataFrame:
    return catalog_of(t).read("suricata").groupBy("event_dataset").agg(F.count(F.lit(1)).alias("docs"))


@query("view_sigma_alerts", "SELECT 'dns-critical/' || _index || '/' || _id AS _id, ts_ms FROM docs WHERE alert_severity = 1")
def view_sigma_alerts(t: Tables) -> DataFrame:
    return catalog_of(t, _hits(t)).read("sigma-alerts").select("_id", millis())


@query(
    "view_additive",
    """
    SELECT _index, _id FROM docs WHERE _index LIKE 'suricata-2024.01.0%' AND event_dataset = 'suricata.dns'
    UNION ALL SELECT _index, _id FROM docs WHERE _index = 'suricata-2024.01.15'
    UNION ALL SELECT _index, _id FROM docs WHERE _index LIKE 'suricata-2024.01.2%' AND destination_port = 443
    """,
)
def view_additive(t: Tables) -> DataFrame:
    catalog = catalog_of(t)
    catalog.create_view("mine", [("suricata-2024.01.0*", {"term": {"event.dataset": "suricata.dns"}})])
    catalog.create_view("mine", [("suricata-2024.01.15", None), ("suricata-2031.*", None)])
    catalog.create_view("mine", [("suricata-2024.01.2*", {"term": {"destination.port": 443}})])
    return catalog.read("mine").select("_index", "_id")


@query(
    "view_coverage",
    """
    WITH v AS (
      SELECT 'alerts' AS view, 'suricata-*' AS pattern, _index, ts_ms FROM alerts
      UNION ALL SELECT 'early', 'suricata-2024.01.0*', _index, ts_ms FROM docs WHERE _index LIKE 'suricata-2024.01.0%' AND network_transport = 'tcp'
      UNION ALL SELECT 'early', 'suricata-2024.01.20', _index, ts_ms FROM docs WHERE _index = 'suricata-2024.01.20')
    SELECT view, pattern, _index, count(*) AS docs, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
      contains(pattern, '*') AS has_wildcard, false AS future_only FROM v GROUP BY view, pattern, _index
    UNION ALL SELECT 'later', 'suricata-2031.*', NULL, NULL, NULL, NULL, true, true
    """,
)
def view_coverage(t: Tables) -> DataFrame:
    views = {
        "alerts": {"suricata-*": ALERT_VIEW_FILTER},
        "early": {"suricata-2024.01.0*": {"term": {"network.transport": "tcp"}}, "suricata-2024.01.20": None},
        "later": {"suricata-2031.*": None},
    }
    found = V.coverage(t.docs(), views)
    return found.select(
        "view", "pattern", "_index", "docs", F.unix_millis("first_event").alias("first_ms"),
        F.unix_millis("last_event").alias("last_ms"), "has_wildcard", "future_only",
    )


_CATALOG_SQL = (
    "WITH "
    + RULES_SQL.strip()
    + """,
rules AS (SELECT file, line_no, source, 'Rule ' || CAST(line_no % 100 AS VARCHAR) || ' seen' AS name,
  CAST(2200070 + line_no % 100 AS VARCHAR) AS sid, 'suricata' AS type, 'alert' AS action,
  CASE line_no % 10 WHEN 0 THEN 'disabled' WHEN 1 THEN 'error' ELSE 'enabled' END AS status
  FROM rule_lines WHERE line_no % 10 IN (0, 1, 6, 7, 8, 9))
"""
)


@query("rule_catalog", _CATALOG_SQL + "SELECT * FROM rules", docs=False)
def rule_catalog(t: Tables) -> DataFrame:
    return R.catalog(rule_lines(t.lines("events")))


@query(
    "rule_search",
    _CATALOG_SQL
    + """
    SELECT file, line_no, name, sid, status, (SELECT count(*) > 50 FROM rules WHERE source = 'local' AND status <> 'disabled'
      AND (contains(lower(name), 'rule 4') OR contains(sid, 'rule 4'))) AS truncated
    FROM rules WHERE source = 'local' AND status <> 'disabled' AND (contains(lower(name), 'rule 4') OR contains(sid, 'rule 4'))
    ORDER BY file, line_no LIMIT 50
    """,
    docs=False,
)
def rule_search(t: Tables) -> DataFrame:
    found, more = R.search_rules(R.catalog(rule_lines(t.lines("events"))), "RULE 4", source="local", limit=50)
    return found.select("file", "line_no", "name", "sid", "status", more.scalar().alias("truncated"))


@query(
    "rule_counts",
    "WITH "
    + RULES_SQL.strip()
    + """
    SELECT count(*) FILTER (WHERE contains(line, 'sid:') AND NOT starts_with(trim(line), '#')) AS enabled,
      count(*) FILTER (WHERE contains(line, 'sid:') AND starts_with(trim(line), '#')) AS disabled,
      count(*) FILTER (WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND (starts_with(line, 'notify')
        OR NOT contains(line, 'msg:') OR NOT contains(line, 'sid:') OR NOT contains(line, 'rev:'))) AS error FROM rule_lines
    """,
    docs=False,
)
def rule_counts(t: Tables) -> DataFrame:
    return R.rule_counts(rule_lines(t.lines("events")))


@query(
    "rule_faults",
    "WITH "
    + RULES_SQL.strip()
    + """
    SELECT file, line_no, source, regexp_extract(line, '^\\s*(\\S+)', 1) AS action,
      CASE WHEN contains(line, 'sid:') THEN trim(split_part(substr(line, strpos(line, 'sid:') + 4), ';', 1)) END AS sid,
      concat_ws(',', CASE WHEN starts_with(line, 'notify') THEN 'action' END, CASE WHEN NOT contains(line, 'msg:') THEN 'msg' END,
        CASE WHEN NOT contains(line, 'sid:') THEN 'sid' END, CASE WHEN NOT contains(line, 'rev:') THEN 'rev' END) AS faults
    FROM rule_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND (starts_with(line, 'notify')
      OR NOT contains(line, 'msg:') OR NOT contains(line, 'sid:') OR NOT contains(line, 'rev:'))
    """,
    docs=False,
)
def rule_faults(t: Tables) -> DataFrame:
    return R.faulty_lines(rule_lines(t.lines("events")))


@query(
    "rule_hits",
    _CATALOG_SQL.replace("WITH", "WITH", 1)
    + """
    , fired AS (SELECT CAST(alert_signature_id AS VARCHAR) AS sid, count(*) AS hits FROM docs WHERE alert_signature_id IS NOT NULL GROUP BY 1)
    SELECT rules.file, rules.line_no, rules.sid, rules.status, coalesce(fired.hits, 0) AS hits FROM rules LEFT JOIN fired USING (sid)
    """,
)
def rule_hits(t: Tables) -> DataFrame:
    hits = R.rule_hits(R.catalog(rule_lines(t.lines("events"))), t.docs())
    return hits.select("file", "line_no", "sid", "status", "hits")


# Sources of every category, picked by the number of the part.
_SOURCES = [
    "aws", "aws_waf-log", "ti_misp-x", "okta-system", "nginx-access", "1password-events", "zzz", "crowdstrike-falcon",
    "windows-security", "auditd-log", "zeek-conn", "proofpoint-mail", "kafka-broker", "splunk-audit",
]


@query(
    "vendor_rollup",
    """
    SELECT v.vendor, count(*) AS count, v.category FROM (SELECT p_partkey % 14 AS i FROM part) p JOIN (VALUES
      (0, 'Aws', 'Other'), (1, 'Aws Waf', 'Cloud'), (2, 'Ti Misp', 'Threat Intel'), (3, 'Okta', 'Identity'),
      (4, 'Nginx', 'DevOps/Web'), (5, '1Password', 'Identity'), (6, 'Zzz', 'Other'), (7, 'Crowdstrike', 'Endpoint'),
      (8, 'Windows', 'Windows'), (9, 'Auditd', 'Linux'), (10, 'Zeek', 'Network'), (11, 'Proofpoint', 'Email'),
      (12, 'Kafka', 'Database'), (13, 'Splunk', 'Security Ops')) v(i, vendor, category) USING (i) GROUP BY ALL
    """,
    docs=False,
)
def vendor_rollup(t: Tables) -> DataFrame:
    stem = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("p_partkey") % len(_SOURCES) + 1).cast("int"))
    category = keyword_category(F.col("vendor"), VENDOR_KEYWORDS, VENDOR_PREFIXES)
    return aggregates.vendor_rollup(t.table("part"), vendor_name(stem), category)


@query(
    "suppress_by_table",
    """
    SELECT _id FROM docs WHERE event_dataset = 'suricata.alert' AND alert_signature_id NOT IN
      (SELECT 2200070 + s_suppkey % 7 FROM supplier)
    """,
)
def suppress_by_table(t: Tables) -> DataFrame:
    listed = t.table("supplier").select((2200070 + F.col("s_suppkey") % 7).alias("sid"))
    alerts = t.docs().where(F.col("event_dataset") == "suricata.alert")
    return D.unsuppressed_by(alerts, listed).select("_id")


