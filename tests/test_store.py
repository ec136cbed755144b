import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lanternlog.functions.fields import flatten, from_leaf
from lanternlog.operators import aggregates, patches, rollback
from lanternlog.operators.enrich import Context, Enrichment, new_run_id, roll_back, run_enrichment
from lanternlog.operators.views import Catalog
from lanternlog.sources.lines import promote
from lanternlog.sources.store import Store

BODIES = {
    "1": {"event": {"dataset": "suricata.alert"}, "alert": {"severity": 1}, "a": {"b": 3}},
    "2": {"event": {"dataset": "suricata.alert"}, "alert": {"severity": 2}, "a": 5, "n": None},
    "3": {"event": {"dataset": "suricata.flow"}, "a": {"b": 1, "c": 2}},
}


def documents(spark, bodies=BODIES):
    rows = [(i, json.dumps(b), dt.datetime(2024, 1, int(i), tzinfo=dt.timezone.utc)) for i, b in bodies.items()]
    df = spark.createDataFrame(rows, "i string, body string, t timestamp").select(
        "i", "t", flatten(F.try_parse_json("body")).alias("fields")
    )
    return promote(df, "suricata", F.col("t"), F.col("i"))


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"))
    out.write(documents(spark), "suricata")
    return out


def state(store, base="suricata"):
    return {r["_id"]: dict(r["fields"]) for r in store.read(base).select("_id", "fields").collect()}


def run(store, fn, name="job", **kw):
    out = run_enrichment(Enrichment(name, fn), {"lab": store}, **kw)
    assert out["results"][0]["ok"], out
    return out


ALERTS = {"term": {"event.dataset": "suricata.alert"}}
T1 = "suricata-2024.01.01"


def test_update_is_visible_promoted_and_audited(store):
    out = run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"alert.severity": 4, "risk.score": 9}))
    assert out["results"][0]["docs_updated"] == 2
    got = {r["_id"]: r["alert_severity"] for r in store.read("suricata").collect()}
    assert got == {"1": 4, "2": 4, "3": None}
    record = store.log().where("doc_id = '1'").first()
    assert record["before"]["alert.severity"]["value"] == "1" and not record["before"]["risk.score"]["exists"]
    assert record["after"] == {"alert.severity": "4", "risk.score": "9"}


def test_expression_patch_and_own_writes_are_seen(store):
    def fn(ctx):
        ctx.update_by_query("suricata", ALERTS, {"risk": F.when(F.col("alert_severity") == 1, 95).otherwise(10)})
        seen = ctx.search("suricata", {"range": {"risk": {"gt": 50}}})
        assert [r["_id"] for r in seen.collect()] == ["1"]
        ctx.update_by_query("suricata", {"range": {"risk": {"gt": 50}}}, {"risk": 96})

    run(store, fn)
    assert {i: f.get("risk") for i, f in state(store).items()} == {"1": "96", "2": "10", "3": None}


def test_scalar_parent_is_replaced_and_comes_back(store):
    before = state(store)
    out = run(store, lambda ctx: ctx.update_by_query("suricata", None, {"a.b": 7}))
    got = state(store)
    assert got["2"]["a.b"] == "7" and "a" not in got["2"] and got["3"]["a.c"] == "2"
    assert roll_back({"lab": store}, out["run_id"])["reverted"] == 3
    assert state(store) == before


def test_object_value_replaces_whole_object(store):
    before = state(store)
    out = run(store, lambda ctx: ctx.update_doc("suricata-2024.01.03", "3", {"a": {"z": {"y": 1}}}))
    assert {k: v for k, v in state(store)["3"].items() if k.startswith("a")} == {"a.z.y": "1"}
    roll_back({"lab": store}, out["run_id"])
    assert state(store) == before


def test_rollback_of_many_operations_is_exact(store):
    before = state(store)

    def fn(ctx):
        ctx.update_by_query("suricata", None, {"a.b": 1, "x": None})
        ctx.update_by_query("suricata", None, {"a": 7})
        ctx.remove_by_query("suricata", None, ["a", "n", "absent"])
        ctx.update_by_query("suricata", ALERTS, {"a.c.d": [1], "event": {"dataset": "other"}})

    out = run(store, fn)
    assert state(store) != before
    result = roll_back({"lab": store}, out["run_id"])
    assert result["errors"] == [] and result["reverted"] == result["total"] == 11
    assert state(store) == before
    # A second rollback changes nothing.
    assert roll_back({"lab": store}, out["run_id"])["reverted"] == 0
    assert state(store) == before


def test_later_change_blocks_unless_forced(store):
    first = run(store, lambda ctx: ctx.update_by_query("suricata", None, {"risk": 1, "o": 1}))["run_id"]
    second = run(store, lambda ctx: ctx.update_doc(T1, "1", {"risk": 2}))["run_id"]
    assert "error" in roll_back({"lab": store}, first)
    plan = roll_back({"lab": store}, first, dry_run=True)
    assert plan["would_revert"] == 3
    assert {r["doc_id"] for r in plan["plan"].where("blocked").collect()} == {"1"}
    # Once the later run is undone it no longer blocks.
    roll_back({"lab": store}, second)
    assert "error" not in roll_back({"lab": store}, first)
    assert all("risk" not in f for f in state(store).values())


def test_different_fields_do_not_block(store):
    first = run(store, lambda ctx: ctx.update_doc(T1, "1", {"risk": 1}))["run_id"]
    run(store, lambda ctx: ctx.update_doc(T1, "1", {"other": 2}))
    assert roll_back({"lab": store}, first)["reverted"] == 1
    assert "error" in roll_back({"lab": store}, "unknown-run")


def test_create_delete_and_missing(store):
    def fn(ctx):
        ctx.index_doc("suricata", {"@timestamp": "2024-01-05T00:00:00Z", "k": 1}, "9")
        with pytest.raises(ValueError):
            ctx.index_doc("suricata", {"@timestamp": "2024-01-05T00:00:00Z"}, "9")
        with pytest.raises(LookupError):
            ctx.update_doc(T1, "nope", {"x": 1})
        with pytest.raises(ValueError):
            ctx.index_doc("suricata", {"@timestamp": "2024-01-01T00:00:00Z"}, "1")
        ctx.delete_doc(T1, "1")

    out = run(store, fn)["results"][0]
    assert (out["docs_created"], out["docs_deleted"], out["docs_updated"]) == (1, 1, 0)
    assert sorted(state(store)) == ["2", "3", "9"]
    assert roll_back({"lab": store}, out["run_id"])["reverted"] == 0
    assert store.compact("suricata") == 2
    assert sorted(state(store)) == ["2", "3", "9"]
    assert store.read("suricata").where("_index = 'suricata-2024.01.05'").count() == 1


def test_dry_run_reads_but_never_writes(store):
    seen = {}

    def fn(ctx, params):
        seen["n"] = ctx.update_by_query("suricata", ALERTS, {"x": params["v"]})["would_update"]
        with pytest.raises(LookupError):
            ctx.update_doc(T1, "nope", {"x": 1})
        seen["d"] = ctx.delete_doc(T1, "1")["would_delete"]

    before = state(store)
    out = run(store, fn, dry_run=True, params={"v": 1})
    assert seen == {"n": 2, "d": 1} and out["results"][0]["dry_run"]
    assert state(store) == before and store.log().isEmpty()


def test_failing_target_leaves_nothing_and_others_go_on(spark, store, tmp_path):
    other = Store(spark, str(tmp_path / "other"))

    def fn(ctx):
        if ctx.cluster == "lab":
            ctx.update_by_query("suricata", None, {"x": 1})
            raise RuntimeError("boom")
        ctx.index_doc("notes", {"k": 1}, "1")

    out = run_enrichment(Enrichment("e", fn, ["lab", "far", "void"]), {"lab": store, "far": other})
    assert [r["ok"] for r in out["results"]] == [False, True, False]
    assert store.log().isEmpty() and all("x" not in f for f in state(store).values())
    assert other.read("notes").count() == 1
    for bad in (Enrichment("e", fn, enabled=False), Enrichment("e", fn, ["far"])):
        with pytest.raises(ValueError):
            run_enrichment(bad, {"lab": store}, cluster="lab")


def test_enrichment_contract():
    with pytest.raises(ValueError):
        Enrichment("e", print, type="play_never")
    with pytest.raises(TypeError):
        Enrichment("e", lambda ctx: None).bound({"a": 1})
    name = new_run_id("job")
    assert name.startswith("job-") and len(name.split("-")[-1]) == 6


def test_rollback_goes_back_to_the_recorded_target(spark, store, tmp_path):
    far = Store(spark, str(tmp_path / "far"))
    far.write(documents(spark), "suricata")
    out = run_enrichment(
        Enrichment("e", lambda ctx: ctx.update_doc(T1, "1", {"x": 1}), ["far"]), {"lab": store, "far": far}
    )
    assert state(far)["1"]["x"] == "1"
    roll_back({"lab": store, "far": far}, out["run_id"])
    assert "x" not in state(far)["1"] and store.log().isEmpty()


def test_compact_changes_no_result(store):
    run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"risk": 1}))
    before = state(store)
    assert store.compact("suricata") == 2
    assert state(store) == before and store.pending_days("suricata") == []
    out = run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"risk": 2}))
    assert state(store)["1"]["risk"] == "2"
    roll_back({"lab": store}, out["run_id"])
    assert state(store) == before


def test_untouched_days_are_read_without_a_join(store):
    run(store, lambda ctx: ctx.update_doc(T1, "1", {"x": 1}))
    plan = store.read("suricata")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1


def test_replace_touches_exactly_one_dataset(spark, store):
    store.write(documents(spark), "suricata-other")
    store.write(documents(spark, {"1": {"k": 1}}), "suricata", mode="replace")
    assert sorted(state(store)) == ["1"] and store.read("suricata-other").count() == 3


def test_views_over_a_store(store):
    catalog = store.catalog()
    out = catalog.create_view("mine", [("suricata-*", ALERTS)])
    assert len(out["tables"]) == 3 and catalog.read("mine").count() == 2
    catalog.create_view("mine", [("suricata-2024.01.03", None), ("later-*", None)])
    assert sorted(r["_id"] for r in catalog.read("mine").collect()) == ["1", "2", "3"]
    assert catalog.read("soc-alerts").count() == 2 and catalog.read("suricata").count() == 3
    assert catalog.read("sigma-alerts").count() == 0
    assert catalog.list_views() == ["mine"] and "soc-alerts" in catalog.list_views(include_reserved=True)
    assert catalog.delete_view("mine")["removed"] == ["suricata-*", "suricata-2024.01.03", "later-*"]


@pytest.mark.parametrize(
    "name,sources",
    [
        ("", [("suricata-*", None)]), ("_all", [("suricata-*", None)]), (".x", [("suricata-*", None)]),
        ("a*", [("suricata-*", None)]), ("soc-alerts", [("suricata-*", None)]), (T1, [("suricata-*", None)]),
        ("v", []), ("v", [("nope", None)]), ("v", [("a/b", None)]), ("v", [("suricata-*", {})]),
        ("v", [("suricata-*", None), (T1, ALERTS)]),
    ],
)
def test_bad_views_are_refused(store, name, sources):
    catalog = store.catalog()
    with pytest.raises(ValueError):
        catalog.create_view(name, sources)
    assert isinstance(catalog, Catalog) and catalog.views == {}


def test_run_list_over_a_log(store):
    ids = [run(store, lambda ctx: ctx.update_doc(T1, "1", {"x": 1}), name)["run_id"] for name in ("b", "a")]
    rows = aggregates.run_list(store.log()).collect()
    assert [r["run_id"] for r in rows] == ids[::-1] and rows[0]["enrichment"] == "a" and rows[0]["operations"] == 1


def test_paths_are_checked():
    for bad in ([], ["a", "a.b"], ["a..b"], [".a"], [""]):
        with pytest.raises(ValueError):
            patches.check_paths(bad)


def test_strict_order_keeps_reverted_runs_blocking(store):
    first = run(store, lambda ctx: ctx.update_doc(T1, "1", {"risk": 1}))["run_id"]
    second = run(store, lambda ctx: ctx.update_doc(T1, "1", {"risk": 2}))["run_id"]
    roll_back({"lab": store}, second)
    assert rollback.later_changes(store.log(), first).isEmpty()
    assert not rollback.later_changes(store.log(), first, strict_reference=True).isEmpty()


def test_context_is_usable_directly(store):
    ctx = Context(store, "lab", "by-hand", "run-x")
    assert ctx.exists(T1, "1") and ctx.get(T1, "1").first()["_id"] == "1"
    assert ctx.summary()["docs_updated"] == 0


def test_rows_without_a_day_survive_a_patch(spark, store):
    store.write(promote(documents(spark).select("fields").limit(1), "suricata", F.lit(None).cast("timestamp"), F.lit("x")), "suricata")
    assert store.read("suricata").count() == 4
    run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"k": 1}))
    assert store.read("suricata").count() == 4


def test_views_outlive_the_catalog_and_are_targets(store):
    store.catalog().create_view("mine", [("suricata-*", ALERTS)])
    run(store, lambda ctx: ctx.update_by_query("mine", None, {"k": 1}))
    assert {i for i, f in state(store).items() if "k" in f} == {"1", "2"}
    store.catalog().delete_view("mine")
    assert "mine" not in store.catalog().list_views()


def test_detections_of_a_store_are_in_the_views(store):
    from lanternlog.operators.detect import Rule, as_documents, detect

    store.write(as_documents(detect(store.read("suricata"), [Rule("r", ALERTS)])), "detections")
    assert store.catalog().read("sigma-alerts").count() == 2
    assert store.catalog().read("soc-alerts").count() == 4
    store.reset_replay(["suricata"])
    assert store.catalog().read("soc-alerts").count() == 0


def test_drop_and_create_in_one_run(store):
    def job(ctx):
        ctx.drop_dataset("suricata")
        assert ctx.read("suricata-*").count() == 0
        ctx.create_dataset("suricata")
        ctx.index_doc("suricata", {"@timestamp": "2024-01-05T00:00:00Z"}, "new")

    run(store, job)
    assert set(state(store)) == {"new"}


def test_a_failed_run_drops_nothing(store):
    def job(ctx):
        ctx.drop_dataset("suricata")
        raise RuntimeError("no")

    out = run_enrichment(Enrichment("e", job), {"lab": store})
    assert not out["results"][0]["ok"] and len(state(store)) == 3


def test_compact_beside_an_open_run_keeps_its_patches(store):
    ctx = Context(store, "lab", "open", new_run_id("open"))
    ctx.update_by_query("suricata", ALERTS, {"k": 1})
    store.compact("suricata")
    ctx.commit()
    assert {i for i, f in state(store).items() if "k" in f} == {"1", "2"}


# One commit for all a change does -----------------------------------------------------------


def test_nothing_comes_back_after_a_run_without_effect(spark, store):
    run(store, lambda ctx: None)
    run(store, lambda ctx: ctx.index_doc("suricata", {"@timestamp": "2024-01-05T00:00:00Z"}, "new"))
    run(store, lambda ctx: ctx.update_by_query("suricata", None, {"x": 1}))
    store.write(documents(spark, {"7": {"k": 1}}), "suricata", mode="replace")
    assert state(store) == {"7": {"k": "1"}}
    assert store.compact("suricata") == 0 and store.pending_days("suricata") == []


def test_a_commit_that_fails_leaves_all_as_it_was(store, monkeypatch):
    before = state(store)

    def job(ctx):
        ctx.drop_dataset("suricata")
        ctx.index_doc("suricata", {"@timestamp": "2024-01-05T00:00:00Z"}, "new")

    for broken in ("put", "_created"):
        with monkeypatch.context() as patch:
            real = getattr(Store, broken)

            def fail(self, *args, real=real):
                if broken == "put" or "commits" in args[0] and "given_up" not in args[1]:
                    raise OSError("disk full")
                return real(self, *args)

            patch.setattr(Store, broken, fail)
            out = run_enrichment(Enrichment("e", job), {"lab": store})
        assert not out["results"][0]["ok"] and state(store) == before
    assert Store(store.spark, store.root)._now() == store._now()
    run(store, job)
    assert set(state(store)) == {"new"}


def test_created_again_after_a_delete(spark, store):
    body = {"@timestamp": "2024-01-05T00:00:00Z", "k": 1}
    t5 = "suricata-2024.01.05"
    run(store, lambda ctx: ctx.index_doc("suricata", body, "n1"))
    run(store, lambda ctx: ctx.update_doc(t5, "n1", {"k": 2, "old": True}))
    run(store, lambda ctx: ctx.delete_doc(t5, "n1"))
    assert "n1" not in state(store)
    run(store, lambda ctx: ctx.index_doc("suricata", body, "n1"))
    assert state(store)["n1"]["k"] == "1" and "old" not in state(store)["n1"]
    run(store, lambda ctx: ctx.update_doc(t5, "n1", {"k": 3}))
    assert state(store)["n1"]["k"] == "3"

    def job(ctx):  # all in one run
        ctx.delete_doc(t5, "n1")
        ctx.index_doc("suricata", body | {"k": 7}, "n1")
        ctx.delete_doc(t5, "n1")
        ctx.index_doc("suricata", body | {"k": 8}, "n1")
        ctx.update_doc(t5, "n1", {"l": 9})

    run(store, job)
    assert (state(store)["n1"]["k"], state(store)["n1"]["l"], len(state(store))) == ("8", "9", 4)
    # rows ingested after a delete are new as well, also once all is folded
    run(store, lambda ctx: ctx.delete_doc(T1, "1"))
    store.write(documents(spark, {"1": {"k": 5}}), "suricata")
    assert state(store)["1"] == {"k": "5"}
    store.compact("suricata")
    assert state(store)["1"] == {"k": "5"} and state(store)["n1"]["l"] == "9" and len(state(store)) == 4


def test_many_appends_are_one_scan_and_one_reading(spark, store, tmp_path):
    """Hundreds of appends: what is read is one scan, and a new reader starts from the last whole state."""
    import shutil

    for ticket in range(2, 200):
        shutil.copytree(f"{store.root}/docs/v=1", f"{store.root}/docs/v={ticket}")
        store._commit({"ticket": ticket, "add": [["suricata", ticket, 0, ["2024-01-01", "2024-01-03"]]]})
    docs = Store(spark, store.root).read("suricata")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert docs.count() == 3 + 198 * 2
    fresh = Store(spark, store.root)
    seen = []
    real = fresh._text
    fresh._text = lambda path: seen.append(path) or real(path)
    assert fresh._now() == store._now() and len(seen) <= 64 + 2


def test_two_writers_lose_nothing(spark, store):
    other = Store(spark, store.root)
    other.create("b")
    store.create("c")
    with pytest.raises(ValueError):
        other.create("c")
    tickets = [s.ticket() for s in (store, other, store, other)]
    assert len(set(tickets)) == 4 and store.bases() == other.bases() == ["b", "c", "suricata"]


def test_a_batch_of_a_stream_counts_once(spark, store):
    extra = documents(spark, {"8": {"k": 1}})
    assert store.write(extra, "suricata", once=("s", 4))
    assert not store.write(extra, "suricata", once=("s", 4))
    assert not store.publish([], once=("s", 3)) and store.progress("s") == 4
    assert len(state(store)) == 4 and store.progress("other") is None


def test_open_runs_of_a_crashed_driver_are_given_up(store):
    ctx = Context(store, "lab", "e", "crashed")
    ctx.update_by_query("suricata", None, {"x": 1})
    run(store, lambda ctx: ctx.update_by_query("suricata", ALERTS, {"y": 1}))
    store.compact("suricata")
    assert store.pending_days("suricata")  # it might still commit
    assert store.give_up() == [ctx._seq] and store.give_up() == []
    assert store.compact("suricata") == 2 and store.pending_days("suricata") == []
    assert all("x" not in f for f in state(store).values())


def test_rollback_reads_only_the_days_of_its_run(store):
    first = run(store, lambda ctx: ctx.update_doc(T1, "1", {"x": 1}))["run_id"]
    for day in (2, 3):
        run(store, lambda ctx: ctx.update_doc(f"suricata-2024.01.0{day}", str(day), {"x": 1}))
    files = store.log_of(first).inputFiles()
    assert len(files) >= 1 and all("doc_day=2024-01-01" in f for f in files)
    assert roll_back({"lab": store}, first)["reverted"] == 1


def test_index_docs(spark, store):
    rows = [("9", '{"@timestamp":"2024-01-05T00:00:00Z","k":1}'), ("9", '{"@timestamp":"2024-01-05T00:00:00Z","k":2}'),
            ("1", '{"@timestamp":"2024-01-01T00:00:00Z"}'), (None, '{"k":3}'), (None, '{"k":3}')]
    frame = lambda r: spark.createDataFrame(r, "id string, body string")
    with pytest.raises(RuntimeError, match="exists"):
        out = run_enrichment(Enrichment("e", lambda ctx: ctx.index_docs("suricata", frame(rows))), {"lab": store})
        raise RuntimeError(out["results"][0]["error"])
    with pytest.raises(RuntimeError, match="no JSON objects"):
        out = run_enrichment(Enrichment("e", lambda ctx: ctx.index_docs("suricata", frame([("x", "[1]")]))), {"lab": store})
        raise RuntimeError(out["results"][0]["error"])
    seen = {}
    out = run(store, lambda ctx: seen.update(ctx.index_docs("suricata", frame(rows), exists="skip")))
    assert (seen["created"], seen["skipped"], out["results"][0]["docs_created"]) == (3, 2, 3)
    assert len(state(store)) == 6 and state(store)["9"]["k"] in ("1", "2")
    assert run(store, lambda ctx: ctx.index_docs("suricata", frame(rows)), dry_run=True)["results"][0]["docs_created"] == 0


def test_targets_run_in_the_order_given(spark, tmp_path):
    order = []
    names = ["c", "a", "b"]
    stores = {n: Store(spark, str(tmp_path / n)) for n in names}
    run_enrichment(Enrichment("e", lambda ctx: order.append(ctx.cluster), names), stores)
    assert order == names


def test_counts_are_read_from_tallies(spark, store):
    """Once asked for, counts come without a scan of documents; days that are patched or rewritten are counted anew."""
    count = lambda: {(str(r["_day"])[-2:], r["event_dataset"]): r["docs"] for r in store.tallies("suricata").collect()}
    whole = {("01", "suricata.alert"): 1, ("02", "suricata.alert"): 1, ("03", "suricata.flow"): 1}
    assert count() == whole
    again = store.tallies("suricata")
    assert all("/tallies/" in f for f in again.inputFiles()) and count() == whole
    run(store, lambda ctx: ctx.update_doc(T1, "1", {"event.dataset": "x"}))
    assert count() == {("01", "x"): 1, ("02", "suricata.alert"): 1, ("03", "suricata.flow"): 1}
    files = [f for f in store.tallies("suricata").inputFiles() if "/docs/" in f]
    assert files and all("_day=2024-01-01" in f for f in files)
    store.compact("suricata")
    store.write(documents(spark, {"3": {"k": 1}}), "suricata")
    assert count() == {("01", "x"): 1, ("02", "suricata.alert"): 1, ("03", "suricata.flow"): 1, ("03", None): 1}
    store.write(documents(spark, {"2": {"k": 1}}), "suricata", mode="replace")
    assert count() == {("02", None): 1}
