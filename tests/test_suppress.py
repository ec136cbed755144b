import datetime as dt

import numpy as np
import pandas as pd
import pytest

from lanternlog.operators.suppress import Limits, kept_moments


def brute(times, window):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= window:
            kept.append(t)
            last = t
    return kept


CASES = {
    "dense": lambda r: np.arange(0, 3000),
    "random": lambda r: r.integers(0, 20_000, 4000),
    "bursts": lambda r: np.concatenate([r.integers(b, b + 300, 700) for b in (0, 5000, 5400, 90_000)]),
    "sparse": lambda r: r.integers(0, 10_000_000, 500),
    "single": lambda r: np.array([7]),
}


@pytest.mark.parametrize("window", [1, 60, 997])
def test_chunked_and_plain_agree_with_brute_force(spark, window):
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"rule_id": "r", "key": k, "us": make(rng)}) for k, make in CASES.items()]
    data = pd.concat(frames).drop_duplicates()
    moments = spark.createDataFrame(data)
    want = {k: brute(g["us"], window) for k, g in data.groupby("key")}
    for limits in (Limits(), Limits(hot=300, chunk=70, fan=3)):
        got = kept_moments(moments, window, limits=limits).toPandas()
        assert {k: sorted(g["us"]) for k, g in got.groupby("key")} == want


def test_continues_from_state(spark):
    data = pd.DataFrame({"rule_id": "r", "key": "k", "us": [100, 130, 161, 200, 221]})
    state = spark.createDataFrame([("r", "k", 101)], "rule_id string, key string, last_us bigint")
    got = kept_moments(spark.createDataFrame(data), 60, state).toPandas()
    assert sorted(got["us"]) == [161, 221]


def test_wild_timestamps_do_not_overflow(spark):
    far = int(dt.datetime(9999, 1, 1).timestamp() * 1_000_000)
    rows = [("r", str(k), us) for k in range(50) for us in (0, 1, far)]
    got = kept_moments(spark.createDataFrame(rows, "rule_id string, key string, us bigint"), 60)
    assert got.count() == 100


def test_hits_without_a_time_and_drawn_ids_are_not_lost(spark):
    from pyspark.sql import functions as F

    from lanternlog.operators.suppress import suppress

    hits = spark.range(2).select(
        F.lit("r").alias("rule_id"), F.col("id").cast("string").alias("query_key"), F.current_timestamp().alias("@timestamp"),
        F.lit("t").alias("event_index"), F.uuid().alias("event_id"),
    )
    assert suppress(hits).count() == 2


def test_late_hit_before_the_window_stays(spark):
    state = spark.createDataFrame([("r", "=k", 1_000)], "rule_id string, key string, last_us bigint")
    moments = spark.createDataFrame([("r", "=k", t) for t in (100, 950, 1_050, 1_100)], "rule_id string, key string, us bigint")
    got = sorted(r["us"] for r in kept_moments(moments, 100, state).collect())
    assert got == [100, 1_100]


def test_late_hits_meet_every_kept_time(spark):
    """State with several kept times: a hit in any of their windows is a repeat."""
    state = spark.createDataFrame([("r", "k", 800), ("r", "k", 1000), ("r", "other", 820)], "rule_id string, key string, last_us bigint")
    moments = spark.createDataFrame([("r", "k", t) for t in (100, 820, 859, 860, 1059, 1061)], "rule_id string, key string, us bigint")
    got = sorted(r["us"] for r in kept_moments(moments, 60, state).collect())
    assert got == [100, 860, 1061]


@pytest.mark.parametrize("window", [10**9, 5000, 1])
def test_chunks_cut_inside_a_window(spark, window):
    """A window longer than the data or than many chunks: chunks hold their number of hits all the same."""
    from lanternlog.operators.suppress import _chunked

    rng = np.random.default_rng(2)
    us = np.unique(rng.integers(0, 30_000, 3000))
    moments = spark.createDataFrame(pd.DataFrame({"rule_id": "r", "key": "k", "us": us}))
    sizes = [r["count"] for r in _chunked(moments, 70).groupBy("node").count().collect()]
    assert max(sizes) == 70 and len(sizes) == -(-len(us) // 70)
    got = kept_moments(moments, window, limits=Limits(hot=300, chunk=70, fan=3)).toPandas()
    assert sorted(got["us"]) == brute(us, window)


def test_running_sums_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    from lanternlog.operators.prefix import running

    rows = [(None if k % 5 == 0 else "hot" if k % 5 < 4 else f"k{k % 3}", k * 7919 % 1000, k % 11) for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, at int, n int")
    got = running(df.repartition(4), ["key"], ["at"], "n").collect()
    assert len(got) == 2000
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: (r["at"], r["running"]))
        by_at = {}
        for r in mine:
            by_at[r["at"]] = max(by_at.get(r["at"], 0), r["running"])
        for at, upto in by_at.items():
            assert upto == sum(n for k, a, n in rows if k == key and a <= at)
    assert running(df.where(F.lit(False)), ["key"], ["at"], "n").count() == 0
