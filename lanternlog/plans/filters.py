"""One query per predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions import net
from lanternlog.functions.predicates import contains_text, where
from lanternlog.model import HOME_NET, TS
from lanternlog.plans.registry import query
from lanternlog.sources.bind import Tables


def _matching(name: str, condition: str, clause: dict | None, now: bool = False) -> None:
    """Register a filter as the ids it selects."""

    @query(name, f"SELECT _id FROM docs WHERE {condition}")
    def plan(t: Tables) -> DataFrame:
        return where(t.docs(), clause, t.now() if now else None).select("_id")


_matching("filter_match_all", "true", {"match_all": {}})
_matching("filter_none", "true", None)
_matching("filter_term", "alert_severity = 3", {"term": {"alert.severity": 3}})
_matching("filter_term_array", "tagged_alert", {"term": {"tags": "alert"}})
_matching("filter_terms", "destination_port IN (22, 53)", {"terms": {"destination.port": [22, 53]}})
_matching("filter_terms_array", "tagged_alert", {"terms": {"tags": ["alert", "other"]}})
_matching(
    "filter_range",
    "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:00:00' AND network_packets > 10",
    {
        "bool": {
            "must": [
                {"range": {TS: {"gte": "2024-01-05T00:00:00", "lt": "2024-01-06T12:00:00Z"}}},
                {"range": {"network.packets": {"gt": 10}}},
            ]
        }
    },
)
_matching(
    "filter_date_math",
    "ts >= (SELECT max(ts) FROM docs) - INTERVAL 24 HOUR AND ts < (SELECT max(ts) FROM docs) - INTERVAL 60 MINUTE",
    {"range": {TS: {"gte": "now-24h", "lt": "now-60m"}}},
    now=True,
)
_matching("filter_exists", "alert_signature IS NOT NULL", {"exists": {"field": "alert.signature"}})
_matching(
    "filter_bool",
    "network_transport = 'tcp' AND NOT coalesce(alert_severity = 1, false) AND "
    "(CAST(k % 2 = 0 AS INTEGER) + CAST(destination_port = 443 OR destination_port = 80 AS INTEGER) "
    "+ CAST(coalesce(alert_action = 'allowed', false) AS INTEGER)) >= 2",
    {
        "bool": {
            "must": [{"term": {"network.transport": "tcp"}}],
            "must_not": [{"term": {"alert.severity": 1}}],
            "should": [
                {"wildcard": {"destination.ip": "172.16.*"}},
                {"terms": {"destination.port": [80, 443]}},
                {"term": {"alert.action": "allowed"}},
            ],
            "minimum_should_match": 2,
        }
    },
)
_matching("filter_wildcard", "regexp_matches(alert_signature, '^S.G-[0-4]$') AND alert_category LIKE 'CAT%'", {
    "bool": {"must": [{"wildcard": {"alert.signature": "S?G-*"}}, {"wildcard": {"alert.category": "CAT*"}},
                      {"terms": {"alert.signature": [f"SIG-{i}" for i in range(5)]}}]}})
_matching("filter_cidr", "source_ip LIKE '10.0.0.%' AND CAST(split_part(source_ip, '.', 4) AS INTEGER) BETWEEN 64 AND 127 "
          "AND destination_ip LIKE '172.16.%'",
          {"bool": {"must": [{"cidr": {"source.ip": "10.0.0.64/26"}}, {"term": {"destination.ip": "172.16.0.0/12"}}]}})
_matching(
    "text_and",
    "regexp_matches(message, '(^|[^a-z0-9_])click([^a-z0-9_]|$)') AND regexp_matches(message, '(^|[^a-z0-9_])12([^a-z0-9_]|$)')",
    {"search": {"query": "12 CLICK", "operator": "and", "fields": ["message"]}},
)
_matching(
    "text_or",
    "regexp_matches(message, '(^|[^a-z0-9_])signup([^a-z0-9_]|$)') OR regexp_matches(message, '(^|[^a-z0-9_])12([^a-z0-9_]|$)')",
    {"search": {"query": "12 signup", "operator": "or", "fields": ["message"]}},
)
_matching(
    "text_all_fields",
    "alert_action = 'blocked' OR event_dataset = 'suricata.tls' OR app_proto = 'tls' OR rule_name = 'RULE-3'",
    {"search": {"query": "BLOCKED tls rule-3", "operator": "or"}},
)
@query("filter_leaf_map", "SELECT _id FROM docs WHERE alert_severity = 2 AND alert_action = 'blocked' AND NOT tagged_alert")
def filter_leaf_map(t: Tables) -> DataFrame:
    # Without promoted columns the same filter reads the leaf map.
    clause = {
        "bool": {
            "must": [{"term": {"alert.severity": 2}}, {"term": {"alert.action": "blocked"}}],
            "must_not": [{"term": {"tags": "alert"}}],
        }
    }
    return where(t.full_docs().select("_id", "fields"), clause).select("_id")


@query(
    "filter_dynamic_path",
    "SELECT _id FROM docs WHERE k % 3 = 1 AND app_proto IS NULL",
)
def filter_dynamic_path(t: Tables) -> DataFrame:
    # Paths without a promoted column are found in the leaf map.
    docs = t.full_docs().select("_id", "fields")
    clause = {
        "bool": {
            "must": [{"term": {"network.transport": "udp"}}, {"range": {"flow_id": {"gte": 0}}}],
            "must_not": [{"exists": {"field": "message2"}}],
        }
    }
    return where(docs, clause).select("_id")


@query(
    "filter_severity_unknown",
    "SELECT _id, alert_severity FROM alerts WHERE alert_severity IS NOT NULL",
)
def filter_severity_unknown(t: Tables) -> DataFrame:
    from lanternlog.operators.feeds import alert_filter
    from lanternlog.plans.alerts import alerts_of

    found = where(alerts_of(t), alert_filter(severity="unknown"))
    return where(found, {"exists": {"field": "alert.severity"}}).select("_id", "alert_severity")


@query(
    "flow_direction",
    """
    SELECT direction, count(*) AS flows FROM (SELECT CASE WHEN k % 2 = 0 THEN 'internal' ELSE 'outbound' END AS direction
      FROM docs WHERE event_dataset = 'suricata.flow') GROUP BY 1
    """,
)
def flow_direction(t: Tables) -> DataFrame:
    from lanternlog.plans.alerts import flows_of

    side = net.direction(F.col("source_ip"), F.col("destination_ip"), HOME_NET)
    return flows_of(t).groupBy(side.alias("direction")).agg(F.count(F.lit(1)).alias("flows"))


@query(
    "contains_ci",
    """
    SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'd#1')
      OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring')
    """,
    docs=False,
)
def contains_ci(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    return t.table("part").where(contains_text("D#1", *columns) | contains_text("Ring", *columns)).select("p_partkey")
