import datetime as dt
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from lanternlog.model import TS
from lanternlog.operators import parse
from lanternlog.operators.detect import Rule, detect
from lanternlog.operators.ingest import Options, ingest_files
from lanternlog.operators.suppress import suppress
from lanternlog.sources import lines as L
from lanternlog.sources.store import Store
from lanternlog.streaming import detect as SD, ingest as SI

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    (home / "App Events.json").write_text(
        '\n{"@timestamp":"2024-01-02T00:00:00Z","event":{"dataset":"x"},"alert":{"severity":"high"}}\nnot json\n[1]\n{"a":1}\n'
    )
    with gzip.open(home / "fw.log.gz", "wt") as f:
        f.write("CEF:0|V|P|1|1|N|5|src=1.1.1.1\nplain\n")
    with zipfile.ZipFile(home / "web.zip", "w") as z:
        z.writestr("first.log", "2024-01-02 03:04:05 GET /a\n\n2024-01-02 03:04:06 POST /b  \n")
        z.writestr("second.log", "never read\n")
    (home / ".hidden").write_text("{}\n")
    (home / "empty.log").write_text("")
    (home / "torn.zip").write_bytes(b"PK no archive")
    return str(home)


def test_lines_of_every_kind_of_file(spark, folder):
    got = {}
    for r in L.read_lines(spark, folder).orderBy("file", "line_no").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1].replace("%20", " "), []).append(r["line"])
    assert sorted(got) == ["App Events.json", "fw.log.gz", "web.zip"]
    assert got["web.zip"] == ["2024-01-02 03:04:05 GET /a", "", "2024-01-02 03:04:06 POST /b  "]


def test_folder_ingest_reports_each_file(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    report = {r["file"].rsplit("/", 1)[-1].replace("%20", " "): r for r in ingest_files(store, folder, now=NOW).collect()}
    assert {n: (r["strategy"], r["docs"]) for n, r in report.items()} == {
        "App Events.json": ("json", 2), "fw.log.gz": ("cef", 2), "web.zip": ("error: text needs a pipeline", 0),
        ".hidden": ("error: hidden name", 0), "empty.log": ("error: empty file", 0), "torn.zip": ("error: not readable", 0),
    }
    assert {n: r["rejected"] for n, r in report.items() if r["rejected"]} == {"App Events.json": 2}
    kept = spark.read.parquet(f"{store.root}/quarantine/*")
    assert sorted(r["line"] for r in kept.collect()) == ["[1]", "not json"]
    assert report["web.zip"]["error"]
    assert store.bases() == ["logs-app-events", "logs-fw-log"]
    rows = store.read("logs-app-events").orderBy(TS).collect()
    assert rows[0]["_index"] == "logs-app-events-2024.01.02" and rows[0]["_malformed"] == ["alert.severity"]
    assert rows[0]["fields"]["alert.severity"] == '"high"' and rows[1][TS].date() == dt.date(2024, 3, 1)
    cef = store.read("logs-fw-log").where("fields['cef.extensions.src'] = '\"1.1.1.1\"'")
    assert cef.count() == 1
    # Appending duplicates; replacing does not.
    ingest_files(store, folder, now=NOW)
    assert store.read("logs-fw-log").count() == 4
    ingest_files(store, folder, Options(mode="replace"), now=NOW)
    assert store.read("logs-fw-log").count() == 2


def test_explicit_pipeline_and_rebase(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    pattern = r"^%{TIMESTAMP_ISO8601:timestamp} %{WORD:verb} %{PATH:path}$"
    pipes = parse.Pipelines({"web": lambda d: parse.text_log(d, pattern)})
    report = ingest_files(store, f"{folder}/web.zip", Options(pipeline="web", base="web", rebase=True), pipes, NOW)
    assert [(r["strategy"], r["docs"]) for r in report.collect()] == [("pipeline:web", 2)]
    rows = store.read("web").select("fields", TS).collect()
    assert {r["fields"]["verb"] for r in rows} == {'"GET"', '"POST"'}
    assert all(r[TS].replace(tzinfo=dt.timezone.utc) == NOW for r in rows)
    assert {r["fields"]["event.created"] for r in rows} == {'"2024-01-02T03:04:05.000Z"', '"2024-01-02T03:04:06.000Z"'}
    wrong = ingest_files(store, f"{folder}/web.zip", Options(pipeline="wbe"), pipes, NOW).first()
    assert wrong["error"] == "error: unknown pipeline wbe"


def test_event_lines_lose_nothing(spark):
    df = spark.createDataFrame([(x,) for x in ('{"a":1}', "", "  ", "oops {", "12", "[]", '{"tags":"one"}')], "value string")
    assert [r["status"] for r in L.parse_events(df).collect()] == ["event", "text", "scalar", "scalar", "event"]
    docs, bad = SI.documents_of(df, "suricata", F.lit(NOW))
    assert (docs.count(), bad.count()) == (2, 3)
    assert docs.where("size(tags) = 1").first()["tags"] == ["one"]


def test_malformed_values_keep_the_document(spark):
    df = spark.createDataFrame([('{"destination":{"port":"x"},"source":{"port":70000000000},"flow_id":7,"timestamp":"bad"}',)], "value string")
    docs, _ = SI.documents_of(df, "suricata", F.lit(NOW))
    row = docs.first()
    assert sorted(row["_malformed"]) == ["destination.port", "source.port"] and row["flow_id"] == 7


def test_chunks_are_read_once_across_restarts(spark, tmp_path):
    home = tmp_path / "chunks"
    home.mkdir()
    body = '{{"timestamp":"2024-01-0{d}T00:00:00.000000+0000","event":{{"dataset":"suricata.flow"}}}}\n'

    def go():
        stream = SI.stream_chunks(spark, str(home), 1)
        SI.land(stream, "suricata", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return SI.landed(spark, str(tmp_path / "out"))

    (home / "a.json").write_text(body.format(d=1) + "junk\n")
    (home / "b.json").write_text(body.format(d=2))
    assert go().count() == 2
    assert go().count() == 2
    (home / "c.json").write_text(body.format(d=3))
    assert sorted(str(r[0]) for r in go().select("_day").collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1


def test_stream_suppression_carries_over_batches_and_matches_batch(spark, tmp_path):
    home = tmp_path / "events"
    schema = f"_index string, _id string, `{TS}` timestamp, flow_id long, alert_severity int"
    rows = [("suricata-2024.01.01", f"{i:03d}", dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=17 * i), i % 2, 1) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(home))
    rule = Rule("r", {"term": {"alert.severity": 1}})
    batch = suppress(detect(spark.read.schema(schema).parquet(str(home)), [rule], F.lit(NOW)), 60)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(home))
    alerts = SD.alerts_of(stream, [rule])
    target = str(tmp_path / "out")
    SD.write_suppressed(alerts, target, str(tmp_path / "cp"), 60).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["event_id"] for r in SD.read_alerts(spark, target, alerts.schema).collect())
    assert got == sorted(r["event_id"] for r in batch.collect()) and 0 < len(got) < 60


def test_two_rules_on_one_event_and_bad_rule(spark):
    df = spark.createDataFrame([("i-1", "a", NOW, 1, {"alert.severity": "1"})], f"_index string, _id string, `{TS}` timestamp, alert_severity int, fields map<string,string>")
    hits = detect(df, [Rule("x", {"term": {"alert.severity": 1}}), Rule("y", None, table="i-*"), Rule("z", {"no": {}}), Rule("w", None, table="j")])
    rows = {r["rule_id"]: r for r in hits.collect()}
    assert sorted(rows) == ["x", "y"] and rows["x"]["query_key"] is None
    assert rows["x"]["fields"] == {"match_body.alert.severity": "1"} and rows["x"][TS] is not None


def test_many_rules_are_one_scan(spark):
    df = spark.range(100).selectExpr("'i' as _index", "cast(id as string) as _id", f"timestamp_seconds(id) as `{TS}`", "cast(id as int) as alert_severity")
    rules = [Rule(f"r{i}", {"term": {"alert.severity": i}}, query_key="alert.severity") for i in range(200)]
    hits = detect(df, rules)
    assert hits.count() == 100
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_damaged_archives_are_rows(spark, tmp_path):
    """What can be read is, and what is wrong is one row a file; the others go on."""
    home = tmp_path / "packed"
    home.mkdir()
    text = "".join(f"line {k} é\n" for k in range(30_000)).encode()
    whole = gzip.compress(text)
    (home / "whole.gz").write_bytes(whole)
    (home / "two.log.GZ").write_bytes(gzip.compress(b"a\r\nb") + gzip.compress(b"c\n\nd"))
    (home / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (home / "junk.gz").write_bytes(b"not packed")
    (home / "empty.gz").write_bytes(gzip.compress(b""))
    (home / ".hidden.gz").write_bytes(whole)
    with zipfile.ZipFile(home / "bad.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.log", text)
    data = bytearray((home / "bad.zip").read_bytes())
    data[len(data) // 2] ^= 0xFF
    (home / "bad.zip").write_bytes(bytes(data))
    (home / "torn.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(home / "none.zip", "w"):
        pass
    rows = L.read_archives(spark, str(home)).collect()
    lines, errors = {}, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["line_no"])):
        name = r["file"].rsplit("/", 1)[-1]
        (errors if r["error"] else lines).setdefault(name, []).append(r["error"] or r["line"])
    assert lines["whole.gz"] == text.decode().split("\n")[:-1] and lines["two.log.GZ"] == ["a", "bc", "", "d"]
    assert 0 < len(lines["cut.gz"]) < 30_000 and lines["cut.gz"][:-1] == lines["whole.gz"][: len(lines["cut.gz"]) - 1]
    assert {n: len(e) for n, e in errors.items()} == {n: 1 for n in ("cut.gz", "junk.gz", "bad.zip", "torn.zip")}
    assert not {"empty.gz", "none.zip", ".hidden.gz", "junk.gz", "torn.zip"} & set(lines)
    store = Store(spark, str(tmp_path / "s"))
    pipes = parse.Pipelines({"text": lambda d: d})
    report = {r["file"].rsplit("/", 1)[-1]: r for r in ingest_files(store, str(home), Options(pipeline="text", base="b"), pipes, NOW).collect()}
    assert report["cut.gz"]["error"].startswith("error: damaged") and report["cut.gz"]["docs"] == len(lines["cut.gz"])
    assert report["whole.gz"]["error"] is None and report["whole.gz"]["docs"] == 30_000
    assert store.read("b").count() == sum(r["docs"] for r in report.values())


def test_long_member_in_bounded_pieces():
    """Far more unpacked bytes than are ever held; no list of lines beyond its bound."""
    import tracemalloc

    packed = gzip.compress(b"0123456789abcde\n" * 4_000_000)
    tracemalloc.start()
    sizes = [len(lines) for lines in L._lines_of(L._gzip_pieces(packed))]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(sizes) == 4_000_000 and max(sizes) < 20_000 + L._PIECE and peak < 16 << 20


def _alert(n, second, key="k"):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)
    return ("detections", f"{n}/{second}", at.date(), at, at, "r", "r", key, "i", f"{n}-{second}", {"a": "1"})


@pytest.mark.parametrize("ordered, want", [(False, [700, 800, 1000, 1060]), (True, [700, 800, 1000, 1060])])
def test_suppression_state_in_the_state_store(spark, tmp_path, ordered, want):
    """Batches out of order; a late hit inside a kept window is suppressed; what is over leaves the state."""
    ddl = (
        f"_index string, _id string, _day date, `{TS}` timestamp, alert_time timestamp, rule_id string, rule_name string, "
        "query_key string, event_index string, event_id string, fields map<string,string>"
    )
    batches = [[800, 1000], [820, 1059, 1060], [700, 1100]]
    rows = [[_alert(n, s) for s in batch] for n, batch in enumerate(batches)] + [[_alert(9, 90_000, None)]]
    for batch in rows:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    alerts = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    out = SD.suppressed(alerts, 60, 1000, ordered)
    running = SD.suppress_into(out, store, str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    found = store.read("detections").where("fields['query_key'] = '\"k\"'")
    assert sorted(int(r["fields"]["event.id"].strip('"').split("-")[1]) for r in found.collect()) == want
    last = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]][-1]
    assert last <= 2  # the other key's only


def test_rules_looked_up_equal_rules_tried(spark):
    schema = f"_index string, _id string, `{TS}` timestamp, flow_id long, alert_severity int, event_dataset string, source_ip string, tags array<string>, fields map<string,string>"
    rows = [(f"i-{k % 3}", str(k), NOW, k % 40 if k % 7 else None, k % 5, ["a", "b", None][k % 3], f"10.0.0.{k % 9}", ["t"], {"x.y": f'"{k % 4}"'}) for k in range(400)]
    df = spark.createDataFrame(rows, schema)
    rules = [Rule(f"flow {k}", {"term": {"flow_id": k}}, query_key="source.ip") for k in range(50)]
    rules += [Rule(f"both {k}", {"bool": {"must": [{"term": {"flow_id": k}}], "filter": {"terms": {"event.dataset": ["a", "c"]}}}}, table="i-1") for k in range(50)]
    rules += [Rule(f"ip {k}", {"term": {"source.ip": {"value": f"10.0.0.{k}"}}}, table="i-*", query_key="x.y") for k in range(9)]
    rules += [Rule("net", {"term": {"source.ip": "10.0.0.0/30"}}), Rule("tag", {"term": {"tags": "t"}}), Rule("leaf", {"term": {"x.y": "1"}})]
    rules += [Rule("twice", {"bool": {"must": [{"term": {"flow_id": 1}}, {"term": {"flow_id": 1}}]}}), Rule("text", {"term": {"flow_id": "7"}})]
    rules += [Rule("none", {"bool": {}}), Rule("bad", {"nonsense": {}}), Rule("wrong", {"term": {"flow_id": "x"}})]
    from lanternlog.operators.detect import prepare

    looked, tried = prepare(df, rules), prepare(df, rules, indexed=10**9)
    assert len(looked.indexed) == 109 and not tried.indexed
    assert looked.errors == tried.errors and {r for r, _ in looked.errors} == {"bad", "wrong"}
    key = lambda r: (r["rule_id"], r["event_id"], r["query_key"], r["_id"])
    got, want = (sorted(map(key, detect(df, s, F.lit(NOW)).collect()), key=str) for s in (looked, tried))
    assert got == want and len(got) > 1000
