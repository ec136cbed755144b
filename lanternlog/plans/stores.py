"""Stores: runs, replacement, compaction, streams that land in them, rollback through the commit record."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.fields import from_leaf
from lanternlog.model import TS
from lanternlog.operators import detect as D, patches as P
from lanternlog.operators.enrich import Context, Enrichment, new_run_id, roll_back, run_enrichment
from lanternlog.plans.registry import millis, query
from lanternlog.session import work_dir
from lanternlog.sources.bind import Tables, event_lines
from lanternlog.sources.store import Store
from lanternlog.streaming import detect as SD, ingest as SI

ALERTS = {"term": {"event.dataset": "suricata.alert"}}
WEB = {"terms": {"destination.port": [80, 443]}}
NOW = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)


def _empty(t: Tables) -> Store:
    return Store(t.spark, work_dir(t.spark, "store"))


def _store(t: Tables) -> Store:
    store = _empty(t)
    store.write(t.full_docs(), "suricata")
    return store


def _run(store: Store, job, name: str = "job", fails: bool = False) -> str:
    out = run_enrichment(Enrichment(name, job), {"lab": store})
    if out["results"][0]["ok"] == fails:
        raise RuntimeError(str(out["results"][0]))
    return out["run_id"]


def _score(name: str = "risk.score") -> F.Column:
    return from_leaf(F.col("fields")[name], "int")


def _by_dataset(docs: DataFrame) -> DataFrame:
    return docs.groupBy("event_dataset").agg(F.count(F.lit(1)).alias("docs"))


def _customers(t: Tables) -> DataFrame:
    """A customer as a document to create, dated by its key."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 9).cast("int")), "yyyy-MM-dd'T00:00:00Z'")
    body = F.struct(day.alias("@timestamp"), F.struct(F.col("c_mktsegment").alias("segment")).alias("customer"))
    return t.table("customer").select(F.col("c_custkey").cast("string").alias("id"), F.to_json(body).alias("body"))


@query(
    "store_dated_write",
    "SELECT _index, count(*) AS docs, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM docs GROUP BY _index",
)
def store_dated_write(t: Tables) -> DataFrame:
    docs = _store(t).read("suricata")
    return docs.groupBy("_index").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.unix_millis(TS)).alias("first_ms"), F.max(F.unix_millis(TS)).alias("last_ms")
    )


@query(
    "store_replace",
    "SELECT event_dataset, count(*) AS docs, CAST(0 AS BIGINT) AS scored FROM docs WHERE event_dataset = 'suricata.alert' GROUP BY 1",
)
def store_replace(t: Tables) -> DataFrame:
    # A run that did nothing, one that created and one that patched come before: none of it comes back.
    store = _store(t)
    _run(store, lambda ctx: None)
    _run(store, lambda ctx: ctx.index_doc("suricata", {"@timestamp": "2024-01-02T00:00:00Z", "event": {"dataset": "new"}}, "new"))
    _run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"risk.score": 1}))
    store.write(t.full_docs().where(F.col("event_dataset") == "suricata.alert"), "suricata", "replace")
    docs = store.read("suricata")
    return docs.groupBy("event_dataset").agg(F.count(F.lit(1)).alias("docs"), F.count(_score()).alias("scored"))


@query("store_failed_run", "SELECT event_dataset, count(*) AS docs FROM docs GROUP BY 1")
def store_failed_run(t: Tables) -> DataFrame:
    # A run that drops, creates and updates, and fails at the end, leaves all as it was.
    store = _store(t)

    def job(ctx: Context) -> None:
        ctx.update_by_query("suricata", None, {"event.dataset": "gone"})
        ctx.drop_dataset("suricata")
        ctx.index_docs("suricata", _customers(t))
        raise RuntimeError("the end")

    _run(store, job, fails=True)
    return _by_dataset(store.read("suricata"))


@query(
    "store_noop_run",
    "SELECT event_dataset, count(*) AS docs FROM docs WHERE event_dataset <> 'suricata.dns' GROUP BY 1",
)
def store_noop_run(t: Tables) -> DataFrame:
    # Runs without effect hold nothing up: what is written after them is folded and replaced as ever.
    store = _store(t)
    _run(store, lambda ctx: None)
    store.give_up()
    _run(store, lambda ctx: ctx.update_by_query("suricata", {"term": {"event.dataset": "suricata.dns"}}, {"event.dataset": "x"}))
    store.compact("suricata")
    if store.pending_days("suricata"):
        raise RuntimeError("records left behind by a compaction")
    return _by_dataset(store.read("suricata").where("event_dataset <> 'x'"))


@query(
    "store_compact",
    """
    SELECT _id, CASE WHEN destination_port IN (80, 443) THEN 10 WHEN event_dataset = 'suricata.alert' THEN 40 END AS score,
      network_transport <> 'icmp' AS has_packets FROM docs
    """,
)
def store_compact(t: Tables) -> DataFrame:
    # Folded, then patched again, beside an open run whose records stay pending and count in the end.
    store = _store(t)
    _run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"risk.score": 40}))
    open_run = Context(store, "lab", "open", new_run_id("open"))
    open_run.update_by_query("suricata", WEB, {"risk.score": 10})
    store.compact("suricata")
    _run(store, lambda ctx: ctx.remove_by_query("suricata", {"term": {"network.transport": "icmp"}}, ["network.packets"]))
    open_run.commit()
    store.compact("suricata", everything=True)
    docs = store.read("suricata")
    return docs.select("_id", _score().alias("score"), F.map_contains_key("fields", "network.packets").alias("has_packets"))


@query(
    "store_recreate",
    """
    SELECT '2024.01.0' || CAST(1 + c_custkey % 9 AS VARCHAR) AS day, c_mktsegment AS segment, c_custkey % 9 < 2 AS anew, count(*) AS docs
    FROM customer GROUP BY ALL
    """,
    docs=False,
)
def store_recreate(t: Tables) -> DataFrame:
    # Documents marked, deleted and created again are new: neither the mark nor the delete counts for them.
    store = _empty(t)
    early = {"terms": {"_index": ["people-2024.01.01", "people-2024.01.02"]}}
    some = _customers(t).where("cast(id as bigint) % 9 < 2")
    _run(store, lambda ctx: ctx.index_docs("people", _customers(t)))

    def job(ctx: Context) -> None:
        ctx.update_by_query("people-*", None, {"old": True})
        ctx.delete_by_query("people-*", early)
        ctx.index_docs("people", some)

    _run(store, job)
    docs = store.read("people")
    return docs.groupBy(
        F.substring("_index", 8, 10).alias("day"), from_leaf(F.col("fields")["customer.segment"]).alias("segment"),
        (~F.map_contains_key("fields", "old")).alias("anew"),
    ).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "store_index_docs",
    """
    SELECT '2024.01.0' || CAST(1 + c_custkey % 9 AS VARCHAR) AS day, count(*) AS docs, count(*) AS audited, count(*) + 7 AS skipped
    FROM customer GROUP BY ALL
    """,
    docs=False,
)
def store_index_docs(t: Tables) -> DataFrame:
    # Half is there already, and every row comes twice: each id is created once, the rest passed over.
    store = _empty(t)
    rows = _customers(t)
    _run(store, lambda ctx: ctx.index_docs("people", rows.where("cast(id as bigint) % 2 = 0")))
    _run(store, lambda ctx: ctx.index_docs("people", rows.unionByName(rows), exists="skip"))
    day = lambda c: F.substring(c, 8, 10).alias("day")
    made = store.log().groupBy(day("index")).agg(F.count(F.lit(1)).alias("audited"))
    docs = store.read("people").groupBy(day("_index")).agg(F.count(F.lit(1)).alias("docs"))
    return docs.join(made, "day").select("day", "docs", "audited", (F.col("docs") + 7).alias("skipped"))


@query(
    "store_run_records",
    """
    SELECT 'update_doc' AS operation, _index AS index, count(*) AS records FROM docs WHERE destination_port IN (80, 443) GROUP BY ALL
    UNION ALL SELECT 'delete_doc', _index, count(*) FROM docs WHERE event_dataset = 'suricata.dns' GROUP BY ALL
    """,
)
def store_run_records(t: Tables) -> DataFrame:
    # Records of one run, found through the commit record among those of others.
    store = _store(t)
    _run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"x": 1}))

    def job(ctx: Context) -> None:
        ctx.update_by_query("suricata", WEB, {"y": 1})
        ctx.delete_by_query("suricata", {"term": {"event.dataset": "suricata.dns"}})

    run_id = _run(store, job)
    _run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"x": 2}))
    log = P.read_run(store.log_of(run_id), run_id)
    return log.groupBy("operation", "index").agg(F.count(F.lit(1)).alias("records"))


@query(
    "store_rollback_blocked",
    """
    SELECT _index, count(*) FILTER (event_dataset = 'suricata.alert') AS in_plan,
      count(*) FILTER (event_dataset = 'suricata.alert' AND destination_port IN (80, 443)) AS blocked FROM docs GROUP BY _index
    HAVING count(*) FILTER (event_dataset = 'suricata.alert') > 0
    """,
)
def store_rollback_blocked(t: Tables) -> DataFrame:
    store = _store(t)
    first = _run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"risk.score": 40, "note": "a"}))
    _run(store, lambda ctx: ctx.update_by_query("suricata", WEB, {"risk.score": 10}))
    if "error" not in roll_back({"lab": store}, first):
        raise RuntimeError("a later change must block the rollback")
    plan = roll_back({"lab": store}, first, dry_run=True)["plan"]
    return plan.groupBy(F.col("index").alias("_index")).agg(
        F.count(F.lit(1)).alias("in_plan"), F.count_if("blocked").alias("blocked")
    )


@query(
    "store_rollback",
    """
    SELECT _id, CASE WHEN destination_port IN (80, 443) THEN 10 END AS score, network_transport AS transport FROM docs
    """,
)
def store_rollback(t: Tables) -> DataFrame:
    # The first run is undone, though forced over a later one; that one's values are put back by undoing nothing of it.
    store = _store(t)
    first = _run(store, lambda ctx: ctx.remove_by_query("suricata", ALERTS, ["network"]))
    _run(store, lambda ctx: ctx.update_by_query("suricata", WEB, {"risk.score": 10}))
    done = roll_back({"lab": store}, first)
    if "error" in done or roll_back({"lab": store}, first)["reverted"]:
        raise RuntimeError("one rollback, once")
    docs = store.read("suricata")
    return docs.select("_id", _score().alias("score"), F.col("network_transport").alias("transport"))


@query(
    "store_overview",
    """
    SELECT event_dataset, count(*) AS docs, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, true AS near FROM (
      SELECT CASE WHEN _index = 'suricata-2024.01.03' AND event_dataset = 'suricata.dns' THEN 'x' ELSE event_dataset END AS event_dataset, ts_ms
      FROM docs) GROUP BY 1
    """,
)
def store_overview(t: Tables) -> DataFrame:
    # From counts and sketches written with the parts; only the day that a run has changed is read.
    store = _store(t)
    store.tallies("suricata")
    dns = {"bool": {"must": [{"term": {"event.dataset": "suricata.dns"}}, {"term": {"_index": "suricata-2024.01.03"}}]}}
    _run(store, lambda ctx: ctx.update_by_query("suricata", dns, {"event.dataset": "x"}))
    store.tallies("suricata")
    found = store.tallies("suricata").groupBy("event_dataset").agg(
        F.sum("docs").alias("docs"), F.min(F.unix_millis("first")).alias("first_ms"), F.max(F.unix_millis("last")).alias("last_ms"),
        F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("estimate"),
    )
    exact = store.read("suricata").groupBy("event_dataset").agg(F.count_distinct("source_ip").alias("n"))
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.col("n") * 0.05, F.lit(2))
    return found.join(exact, "event_dataset").select("event_dataset", "docs", "first_ms", "last_ms", near.alias("near"))


# Streams ---------------------------------------------------------------------------------


def _chunks(t: Tables, n: int) -> list[DataFrame]:
    """Event lines in n batches by event, none empty."""
    lines = event_lines(t.lines("events"))
    return [lines.where(F.col("event_id") % n == k).select("value") for k in range(n)]


_LANDED = """
SELECT strftime(ts, '%Y-%m-%d') AS day, 'suricata.' || event_type AS event_dataset, count(*) AS docs FROM events
WHERE event_id % 50 > 2 GROUP BY ALL
"""


@query("store_stream_ingest", _LANDED, docs=False)
def store_stream_ingest(t: Tables) -> DataFrame:
    # A stream of files in three batches or more; then its last batch is replayed, as after a crash.
    store = _empty(t)
    folder = work_dir(t.spark, "chunks")
    for k, part in enumerate(_chunks(t, 3)):
        part.repartition(1).write.text(f"{folder}/in/{k}")
    lines = SI.stream_chunks(t.spark, f"{folder}/in/*", files_per_batch=1, pattern="*.txt")
    SI.land_in(lines, store, "suricata", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    last = store.progress("ingest suricata")
    SI.lander(store, "suricata", "ingest suricata")(_chunks(t, 3)[0], last)
    day = F.date_format("_day", "yyyy-MM-dd").alias("day")
    return store.read("suricata").groupBy(day, "event_dataset").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "store_stream_detect",
    """
    SELECT CAST(1 + k % 4 AS INTEGER) AS severity, count(*) AS alerts
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    WHERE event_id % 50 > 2 AND k % 10 <> 7 AND k % 4 < 2 GROUP BY ALL
    """,
    docs=False,
)
def store_stream_detect(t: Tables) -> DataFrame:
    # What was there before the rules came is looked at by look-back; then every batch once, one of them replayed.
    store = _empty(t)
    rules = [D.Rule("severe", {"range": {"alert.severity": {"lte": 2}}})]
    landing = SI.lander(store, "suricata", "in")
    batches = _chunks(t, 4)
    landing(batches[0], 0)
    SD.detect_new(store, "suricata", rules, now=NOW, days=4000)
    for k, batch in enumerate(batches[1:], 1):
        landing(batch, k)
        landing(batch, k)
        SD.detect_new(store, "suricata", rules, now=NOW)
        if SD.detect_new(store, "suricata", rules, now=NOW):
            store.compact("suricata", everything=True)
    store.compact("suricata", everything=True)
    SD.detect_new(store, "suricata", rules, now=NOW)
    found = store.read("detections")
    severity = from_leaf(F.col("fields")["match_body.alert.severity"], "int").alias("severity")
    return found.groupBy(severity).agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "store_stream_rules",
    "SELECT count(*) AS alerts FROM events WHERE event_id % 50 > 2 AND event_type = 'error'",
    docs=False,
)
def store_stream_rules(t: Tables) -> DataFrame:
    # Rules judged on arrival: documents and alerts of a batch are one commit.
    store = _empty(t)
    rules = [D.Rule("errors", {"term": {"event.dataset": "suricata.error"}})]
    landing = SI.lander(store, "suricata", "in", rules)
    for k, batch in enumerate(_chunks(t, 3)):
        landing(batch, k)
    landing(_chunks(t, 3)[2], 2)
    return store.read("detections").agg(F.count(F.lit(1)).alias("alerts"))
