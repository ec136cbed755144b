"""Work is shared out by rows, and a line is parsed once."""

import json

import pytest
from pyspark.sql import functions as F

from lanternlog import session
from lanternlog.functions import fields as L
from lanternlog.sources import lines
from lanternlog.sources.bind import event_documents, event_lines, with_leaves

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _events(spark, n=60):
    rows = [(i, i % 7, ["error", "click"][i % 2], i / 4, json.dumps({"k": i % 100}) if i % 9 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    return df.select("event_id", F.lit("2024-01-05 10:00:00").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def test_one_split_of_packed_rows_becomes_many_tasks(spark, tmp_path, monkeypatch):
    _events(spark, 20_000).coalesce(1).write.parquet(path := str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "SHARE", size // (4 * cores), raising=False)
    spread = session.spread(spark.read.parquet(path))
    assert spread.rdd.getNumPartitions() >= 4 * cores
    assert spread.count() == 20_000


@pytest.mark.parametrize("status", ["event", "text"])
def test_lines_are_parsed_once_and_after_they_are_spread(spark, tmp_path, status):
    _events(spark).coalesce(1).write.parquet(path := str(tmp_path / "t"))
    shared = session.spread(spark.read.schema(EVENTS).parquet(path))
    found = lines.parse_events(event_lines(shared)).where(F.col("status") == status)
    plan = found.select("event_id", "status", "fields")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.index("parseJson") < plan.index("Repartition")
    assert {r["event_id"] % 50 for r in found.collect()} == ({0} if status == "text" else set(range(3, 50)))


def test_status_and_fields_of_odd_lines(spark):
    odd = [None, "", " \u00a0", "x", "5", "null", "[1]", "{}", '{"":{"":{"a":1}}}', ' {"a":{"b":{}}}', '{"a":1,"a":2}', '{"status":1}']
    df = spark.createDataFrame([(i, v, "old") for i, v in enumerate(odd)], "i int, value string, status string")
    got = {r["i"]: (r["status"], r["fields"]) for r in lines.parse_events(df).collect()}
    assert got == {
        3: ("text", None), 4: ("scalar", None), 5: ("scalar", None), 6: ("scalar", None), 7: ("event", {}),
        8: ("event", {"a": "1"}), 9: ("event", {"a.b": "{}"}),
        10: ("text", None), 11: ("event", {"status": "1"}),
    }


def test_depth_is_followed_in_the_tightest_text(spark):
    for depth in (1, 2, 3, 30):
        body = '{"":' * depth + "1" + "}" * depth
        df = spark.createDataFrame([(body,)], "b string")
        for text in (F.col("b"), None):
            (got,) = df.select(L.flatten(F.try_parse_json("b"), text)).first()
            assert list(got.values()) == ["1"]


def test_leaves_of_whole_numbers(spark):
    docs = event_documents(_events(spark))
    plain = spark.createDataFrame([], docs.schema)
    assert with_leaves(plain).count() == 0
    for row in with_leaves(docs).collect():
        for path, name in (("flow_id", "flow_id"), ("source.port", "source_port"), ("message", "message"), ("event.duration", "event_duration")):
            value = row[name]
            assert row["fields"].get(path) == (None if value is None else json.dumps(value))
