"""What operators leave on disk while they work."""

import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from lanternlog import session
from lanternlog.llm import jaccard_join, tables
from tests.llm.test_brute_force import components


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in re.findall(r"shuffle_\d+_\d+_\d+", blocks.mkString(" "))}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    made = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    read = tables.stored(made.join(made.withColumnRenamed("n", "m"), "k"), "counts")
    for _ in range(50):  # they are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert read.count() == 1000 and read.agg(F.sum("n"), F.sum("m")).first() == (20_000, 20_000)
    # what somebody else set for their own queries stays
    spark.conf.set(tables._CLEANUP, "false")
    tables.stored(made, "counts")
    assert spark.conf.get(tables._CLEANUP) == "false"
    spark.conf.unset(tables._CLEANUP)


def test_tables_go_when_they_are_read_for_the_last_time(spark, monkeypatch):
    """Near copies of one text, and others: the signatures are gone when sets are compared, all is at the end."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base = prose(60)
    texts = [base] + [[*base[:k], f"e{k}", *base[k + 1 :]] for k in range(59)] + [prose(40) for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    there = {}

    def watched(df, name, write=tables.stored):
        there[name] = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p not in others}
        return write(df, name)

    others = set(folder.iterdir())
    monkeypatch.setattr(jaccard_join, "stored", watched)
    got = jaccard_join.join(docs)
    assert "signatures" in there["points"] and "points" in there["sizes"] and "regions" in there["pairs"]
    assert not {"signatures", "points", "sizes", "regions"} & there["found"]
    assert sorted(r["component_id"] for r in got.collect()) == [0] * 60 + list(range(60, 100))


def test_common_shingles_that_no_task_saw_often_crowd_no_regions(spark, monkeypatch):
    """Unrelated texts with the same ten phrases, and near copies among them, as if tasks had seen too little of all."""
    monkeypatch.setattr(jaccard_join, "OFTEN", 1 << 40)
    rng = random.Random(21)
    phrases = [[f"p{k}.{j}" for j in range(4)] for k in range(10)]
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [[w for phrase in phrases for w in [*phrase, *fresh(rng.randint(4, 6))]] for _ in range(150)]
    for k in range(0, 60, 2):
        texts.append([*texts[k][:-1], "other"])
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rows = {}

    def watched(df, name, write=tables.stored):
        out = write(df, name)
        if name == "crowds":
            rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    table = spark.createDataFrame([*docs, docs[3], docs[160], (None, docs[0][1]), (500, None)], "doc_id bigint, text string").repartition(3)
    found = [tuple(r) for r in jaccard_join.join(table).select("doc_id", "n_shingles", "component_id").collect()]
    linked = {d: (n, c) for d, n, c in components(docs, 4, 85)}
    want = [(d, *linked[d]) for d, _ in [*docs, docs[3], docs[160]]] + [(None, linked[0][0], None), (500, 0, 500)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert len({c for _, c in linked.values()}) == 150
    assert rows["crowds"] < len(docs) / 4
