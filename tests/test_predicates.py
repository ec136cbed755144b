import datetime as dt
import ipaddress

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import net
from lanternlog.functions.predicates import compile_filter, validate_filter, where
from lanternlog.model import HOME_NET, TS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("1", "alert", 1, ["alert", "x"], "10.0.0.1", {"risk.score": "5", "note": "null", "user.name": '"admin1"'}),
        ("2", None, None, None, "8.8.8.8", {"risk.score": "50", "user.name": '"bob"', "labels": '["a","b"]'}),
        ("3", "flow", 3, [], "fd00::1", {}),
    ]
    return spark.createDataFrame(
        rows, "_id string, event_dataset string, alert_severity int, tags array<string>, source_ip string, fields map<string,string>"
    )


def ids(df, query, **kw):
    return sorted(r[0] for r in where(df, query, **kw).select("_id").collect())


def test_empty_matches_everything(docs):
    assert ids(docs, None) == ids(docs, {}) == ids(docs, {"match_all": {}}) == ["1", "2", "3"]


def test_missing_never_matches_but_negation_does(docs):
    assert ids(docs, {"term": {"event.dataset": "alert"}}) == ["1"]
    assert ids(docs, {"bool": {"must_not": [{"term": {"event.dataset": "alert"}}]}}) == ["2", "3"]


def test_term_on_list_and_terms_overlap(docs):
    assert ids(docs, {"term": {"tags": "alert"}}) == ["1"]
    assert ids(docs, {"terms": {"tags": ["x", "y"]}}) == ["1"]
    assert ids(docs, {"term": {"labels": "b"}}) == ["2"]


def test_exists_ignores_null(docs):
    assert ids(docs, {"exists": {"field": "note"}}) == []
    assert ids(docs, {"exists": {"field": "risk"}}) == ["1", "2"]
    assert ids(docs, {"exists": {"field": "tags"}}) == ["1"]


def test_range_wildcard_and_dynamic(docs):
    assert ids(docs, {"range": {"risk.score": {"gt": 5}}}) == ["2"]
    assert ids(docs, {"range": {"risk.score": {"gte": 5, "lt": 50}}}) == ["1"]
    assert ids(docs, {"wildcard": {"user.name": "admin*"}}) == ["1"]
    assert ids(docs, {"wildcard": {"user.name": "?ob"}}) == ["2"]


def test_should(docs):
    either = [{"term": {"alert.severity": 1}}, {"exists": {"field": "risk"}}]
    assert ids(docs, {"bool": {"should": either}}) == ["1", "2"]
    assert ids(docs, {"bool": {"should": either, "minimum_should_match": 2}}) == ["1"]
    # With a required clause the alternatives are optional.
    assert ids(docs, {"bool": {"must": [{"term": {"event.dataset": "flow"}}], "should": either}}) == ["3"]


def test_search_words(docs):
    assert ids(docs, {"search": {"query": "ALERT 10.0.0.1", "operator": "and"}}) == ["1"]
    assert ids(docs, {"search": {"query": "bob flow"}}) == ["2", "3"]
    assert ids(docs, {"search": {"query": "admin"}}) == []  # whole words only


def test_cidr_through_term(docs):
    assert ids(docs, {"term": {"source.ip": "10.0.0.0/8"}}) == ["1"]
    assert ids(docs, {"cidr": {"source.ip": ["fc00::/7", "8.0.0.0/8"]}}) == ["2", "3"]


def test_date_math_and_day_bound(spark):
    now = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)
    rows = [(str(h), now - dt.timedelta(hours=h), (now - dt.timedelta(hours=h)).date()) for h in (0, 1, 23, 25)]
    df = spark.createDataFrame(rows, f"_id string, `{TS}` timestamp, _day date")
    query = {"range": {TS: {"gte": "now-24h"}}}
    assert ids(df, query, now=now) == ["0", "1", "23"]
    assert "_day" in str(compile_filter(df, query, now)._jc)
    assert ids(df, {"range": {TS: {"lt": "2024-01-09T12:00:00"}}}) == ["25"]


def test_validation(docs):
    validate_filter(docs, {"term": {"unseen": 1}})
    for bad in ("text", {}, {"nope": {}}, {"term": {}}, {"bool": {"wish": []}}, {"range": {"a": {"near": 1}}}):
        with pytest.raises(ValueError):
            validate_filter(docs, bad)


def test_network_membership_matches_the_standard_library(spark):
    addresses = [
        "10.1.2.3", "172.31.255.255", "172.32.0.0", "100.64.0.1", "127.0.0.255", "127.0.1.0", "::1", "::2", "fdff::",
        "fe00::", "fc00:0:0:0:1:2:3:4", "::", "2001:db8::8:800:200c:417a", "1:2:3:4:5:6:7:8", "0.0.0.0", "255.255.255.255",
    ]
    broken = ["", "1.2.3", "1.2.3.256", "::1::", "12345::", "1:2:3", "abc", "1:2:3:4:5:6:7:8:9", None]
    df = spark.createDataFrame([(a,) for a in addresses + broken], "ip string")
    home = [ipaddress.ip_network(n) for n in HOME_NET]
    got = {r[0]: r[1] for r in df.select("ip", net.cidr_any(F.col("ip"), HOME_NET)).collect()}
    for a in addresses:
        assert got[a] == any(ipaddress.ip_address(a) in n for n in home), a
    assert not any(got[b] for b in broken if b in got)
    hexes = {r[0]: r[1] for r in df.select("ip", net.ipv6_hex(F.col("ip"))).collect()}
    for a in addresses:
        expected = f"{int(ipaddress.ip_address(a)):032x}" if ":" in a else None
        assert hexes[a] == expected, a
    assert all(hexes[b] is None for b in broken)


def test_direction(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", "10.0.0.2"), ("10.0.0.1", "8.8.8.8"), ("8.8.8.8", "::1"), ("8.8.8.8", "9.9.9.9"), (None, "::1")],
        "s string, d string",
    )
    got = [r[0] for r in df.select(net.direction(F.col("s"), F.col("d"), HOME_NET)).collect()]
    assert got == ["internal", "outbound", "inbound", "external", None]


def test_per_file_heads_are_cut_before_the_shuffle(spark):
    import re

    from lanternlog.operators.feeds import tail_lines
    from lanternlog.operators.quality import representative_sample
    from lanternlog.sources.lines import detect_format

    df = spark.range(5000).selectExpr("id % 2 as file", "id as line_no", "cast(id as string) as line")
    for plan in (tail_lines(df, 3), representative_sample(df), detect_format(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"WindowGroupLimit.*Partial", text), text


def test_filters_reach_the_scan(spark):
    from lanternlog.sources.bind import Tables

    docs = Tables(spark, "/root/testdata/sf0.001").docs()
    found = where(docs, {"range": {TS: {"gte": "2024-01-05T00:00:00"}}}).select("_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp>" in plan


def test_dynamic_paths_compare_as_what_the_bound_is(spark):
    rows = [("1", {"seen": '"2024-03-01T11:00:00Z"', "r": "5", "tags": '["ab","cd"]'}), ("2", {"seen": '"2024-01-01T00:00:00Z"', "r": "50"})]
    df = spark.createDataFrame(rows, "_id string, fields map<string,string>")
    now = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
    assert ids(df, {"range": {"seen": {"gte": "now-24h"}}}, now=now) == ["1"]
    assert ids(df, {"range": {"r": {"lt": "10"}}}) == ["1"]
    assert ids(df, {"wildcard": {"tags": "c*"}}) == ["1"]


def test_a_literal_that_does_not_fit_is_an_error_of_its_rule_only(docs):
    from lanternlog.operators.detect import Rule, prepare

    rules = [Rule("bad", {"term": {"alert.severity": "high"}}), Rule("good", {"term": {"alert.severity": "1"}})]
    got = prepare(docs.withColumn("_index", F.lit("t")), rules)
    assert [r.rule_id for r, _ in got.rules] == ["good"] and [e[0] for e in got.errors] == ["bad"]
