import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import projections as P
from lanternlog.model import TS
from lanternlog.operators import parse, quality, rules

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_cef_cases(spark):
    df = lines(
        spark,
        r"host CEF:0|V|P|1.0|100|Name|7|src=10.0.0.1 msg=a b \= c dst=10.0.0.2",
        "CEF: 1 |V|P|1.0|100|Name|7",
        "CEF:0|V|P|1.0|100|Name",
        "no marker at all\t",
        "CEF:0|V|P|1|1|N|5|k=1 k=2\t",
        r"CEF:0|V\|W|P|1|1|N|5|größe=3",
        "   ",
    )
    rows = parse.parse_cef(df, "line", F.lit(NOW)).collect()
    assert len(rows) == 6
    assert rows[0]["cef"]["name"] == "Name" and rows[0]["cef"]["version"] == "0"
    assert rows[0]["extensions"] == {"src": "10.0.0.1", "msg": "a b = c", "dst": "10.0.0.2"}
    assert rows[1]["cef"]["version"] == "1" and rows[1]["extensions"] is None
    assert rows[2]["message"] == "CEF:0|V|P|1.0|100|Name" and rows[2][TS] is None
    assert rows[3]["message"] == "no marker at all"
    assert rows[4]["extensions"] == {"k": "2"}
    assert rows[5]["cef"]["device_vendor"] == "V\\" and rows[5]["cef"]["severity"] == "N"
    kept = parse.parse_cef(df, "line", F.lit(NOW), escaped_pipes=True).collect()[5]
    assert kept["cef"]["device_vendor"] == "V\\|W" and kept["extensions"] == {"größe": "3"}


def test_grok_first_match_types_and_failure(spark):
    df = lines(spark, "x 10.0.0.1 took 15 ms", "nothing here", "␞ 10.0.0.2 took 7 ms").withColumnRenamed("line", "message")
    got = parse.grok(df, "message", "%{IP:ip} took %{NUMBER:ms:int}").collect()
    assert [(r["ip"], r["ms"]) for r in got] == [("10.0.0.1", 15), (None, None), ("10.0.0.2", 7)]
    assert got[0]["parse_error"] is None and "nothing here" in got[1]["parse_error"]
    with pytest.raises(ValueError):
        parse.grok_regex("%{NOPE:x}")


def test_dates(spark):
    texts = ["2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05+0200", "2024-01-02 03:04:05.678", "2024-01-02 03:04:05",
             "2024/01/02-03:04:05Z", "2024-01-02", "yesterday"]
    got = [r[0] for r in lines(spark, *texts).select(F.unix_millis(parse.date_value(F.col("line")))).collect()]
    base = int(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp() * 1000)
    day = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got == [base + 678, base - 7_200_000, base + 678, base, base, day, None]


def test_kv(spark):
    got = [r[0] for r in lines(spark, 'a=1 "b"="x=y" a=2', "a=1 loose").select(parse.kv_map(F.col("line"))).collect()]
    assert got == [{"a": "2", "b": "x=y"}, None]


def test_shift_keeps_spacing_and_unreadable_rows(spark):
    times = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5), None]
    df = spark.createDataFrame([(t,) for t in times], f"`{TS}` timestamp")
    got = [r[0] for r in parse.shift_to_now(df, F.lit(NOW)).select(F.unix_seconds(TS)).collect()]
    start = int(NOW.timestamp())
    assert got == [start, start + 300, None]


def test_dispatch_keeps_the_alert_dataset(spark):
    df = spark.createDataFrame(
        [("suricata.alert", "dns"), ("suricata.dns", None), ("suricata.odd", None)],
        "event_dataset string, message2_app_proto string",
    )
    branches = {"suricata.dns": {"event_dataset": F.lit("changed"), "q": F.lit("dns")}, "suricata.alert": {"a": F.lit(1)}}
    got = {r["event_dataset"]: (r["q"], r["a"]) for r in parse.dispatch(df, branches).collect()}
    assert got == {"suricata.alert": ("dns", 1), "changed": ("dns", None), "suricata.odd": (None, None)}


def test_pipelines_hint_and_skip(spark):
    steps = parse.Pipelines({"apache.access": lambda d: d.withColumn("p", F.lit(1)), "nginx": lambda d: d})
    assert steps.run(lines(spark, "x"), ["apache.access", "missing"]).columns == ["line", "p"]
    with pytest.raises(ValueError, match="did you mean apache.access"):
        steps.resolve("apache")


def test_service_lines(spark):
    df = lines(spark, '{"@timestamp":"2024-01-02T03:04:05.6Z","log.level":"warn","message":"m"}', '{"log.level": broken',
               '{"log.level":null,"a":1}', "  plain ", "")
    got = [r[0] for r in quality.normalize_service_logs(df).collect()]
    assert got[:2] == ["2024-01-02 03:04:05 [WARN] m", '{"log.level": broken']
    assert got[3] == "plain" and len(got) == 4


@pytest.mark.parametrize("n", [0, 1, 24, 25, 60, 450])
def test_sample_follows_the_rule(spark, n):
    texts = [f"line {i % 40} " + "x" * (i * 7 % 50) for i in range(n)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)] + [("g", 0, " ")], "file string, line_no int, line string")
    got = [r["line"] for r in quality.representative_sample(df).orderBy("rank").collect()]
    head = texts[:400]
    if len(head) <= 24:
        assert got == head
        return
    middle = len(head) // 2
    by_length = sorted(range(len(head)), key=lambda i: -len(head[i]))[:20]
    order = [*range(8), *range(middle - 4, middle + 4), *range(len(head) - 8, len(head)), *by_length]
    assert got == list(dict.fromkeys(head[i] for i in order))[:24]


def test_parse_gate_thresholds(spark):
    def verdict(rows):
        df = spark.createDataFrame(rows, "n int, failed boolean")
        return quality.parse_gate(df, F.col("n"), F.col("failed")).first()["passed"]

    assert verdict([(2, False)] * 4 + [(0, True)])
    assert not verdict([(1, False)] * 5)
    assert not verdict([(5, False)] * 3 + [(0, True)] * 2)


def test_projections(spark):
    got = spark.range(1).select(
        P.safe_base(F.lit("/a/My Log (1).tar.gz")), P.safe_base(F.lit("___.log")), P.vendor_name(F.lit("1password_x-log")),
        P.vendor_name(F.lit("abuse.ch")), P.bytes_floor(F.lit(5 * 1024**4)), P.bytes_decimal(F.lit(3 * 1024**4)),
        P.endpoint(F.lit("1.1.1.1"), F.lit(0)), P.endpoint(F.lit(""), F.lit(80)),
        P.flow_bytes(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"), F.lit(None).cast("bigint")),
    ).first()
    assert tuple(got) == ("my-log-1-tar", "logs", "1Password X", "Abuse.Ch", "5 GB", "3.0 TB", "1.1.1.1", "—:80", 5)


def test_rule_lines(spark):
    rows = [
        'alert tcp any any -> any any (msg:"A; b"; sid:1; rev:1;)', "alert tcp (sid:2; rev:1;)", 'alert x (msg:"N"; sid:3;)',
        '## alert x (msg:"D"; sid:4; rev:1;)', 'notify (msg:"U"; sid:5; rev:1;)', "", "# words",
    ]
    df = spark.createDataFrame([("f", i, "local", r) for i, r in enumerate(rows)], "file string, line_no int, source string, line string")
    got = {r["sid"]: (r["name"], r["status"]) for r in rules.catalog(df).collect()}
    assert got == {"1": ("A", "enabled"), "3": ("N", "error"), "4": ("D", "disabled")}
    assert tuple(rules.rule_counts(df).first()) == (4, 1, 3)
    found, more = rules.search_rules(rules.catalog(df), status="disabled", limit=1)
    assert found.count() == 1 and not more.first()[0]
