"""Standing rules over documents: all rules in one scan, hits as alert documents."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.fields import to_leaf
from lanternlog.functions.predicates import Fields, compile_filter
from lanternlog.model import TS
from lanternlog.operators.views import DETECTIONS
from lanternlog.sources.lines import promote

LOOK_BACK_DAYS = 180
#: From this many rules on, those that only ask for equal values are looked up by value, not tried one by one.
INDEXED = 64


@dataclass(frozen=True)
class Rule:
    rule_id: str
    query: dict[str, Any] | None
    table: str = "*"
    query_key: str = "flow_id"
    action: str = "debug"


@dataclass
class RuleSet:
    """Rules split into those that analyse on a frame and the errors of the rest."""

    rules: list[tuple[Rule, Column]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    indexed: list[tuple[Rule, dict[str, list[str]]]] = field(default_factory=list)


def prepare(df: DataFrame, rules: Sequence[Rule], now: Any = None, indexed: int = INDEXED) -> RuleSet:
    out = RuleSet()
    fields = Fields(df.schema)
    simple = {id(rule): found for rule in rules if (found := equalities(rule.query, fields))}
    if len(simple) < indexed:
        simple = {}
    for rule in rules:
        if id(rule) in simple:
            out.indexed.append((rule, simple[id(rule)]))
            continue
        try:
            test = compile_filter(df, rule.query, now)
            table = rule.table or "*"
            if table != "*":
                test = test & (F.col("_index").rlike(_pattern(table)) if "*" in table else F.col("_index") == table)
            df.where(test).schema
        except Exception as error:
            out.errors.append((rule.rule_id, str(error).splitlines()[0]))
        else:
            out.rules.append((rule, test))
    return out


def _pattern(table: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in table.split("*")) + "$"


def equalities(query: dict[str, Any] | None, fields: Fields) -> dict[str, list[str]] | None:
    """Typed column -> texts it may have, for a filter that is nothing but such conditions; else None."""
    try:
        ((kind, body),) = (query or {}).items()
        if kind == "bool":
            if set(body) - {"must", "filter"}:
                return None
            parts = [q for key in body for q in ([body[key]] if isinstance(body[key], dict) else body[key])]
            out: dict[str, list[str]] = {}
            for part in parts:
                for column, values in (equalities(part, fields) or {"": []}).items():
                    if not column or column in out:
                        return None
                    out[column] = values
            return out or None
        if kind not in ("term", "terms"):
            return None
        ((path, value),) = body.items()
        values = value if kind == "terms" else [value["value"] if isinstance(value, dict) else value]
        column = fields.promoted(path)
        whole = str(fields.types.get(column or "", "")).startswith(("IntegerType", "LongType", "ShortType"))
        text = str(fields.types.get(column or "", "")).startswith("StringType")
        right = int if whole else str
        if not (whole or text) or not all(type(v) is right for v in values):
            return None
        if path.endswith(".ip") and any("/" in v for v in values if text):
            return None
        return {column: [str(v) for v in values]}
    except (AttributeError, TypeError, ValueError, KeyError):
        return None


def _looked_up(df: DataFrame, ruleset: RuleSet, fields: Fields) -> DataFrame:
    """Events with ``_hit`` of the rules that are found by value: one join by (column, value), then the other conditions.

    Each rule stands under one of its columns, the one whose values tell most rules apart. An event offers one value for
    each such column, so what an event costs depends on the columns and its hits, hardly on the number of rules.
    """
    told = {c: {v for _, q in ruleset.indexed for v in q.get(c, ())} for _, q in ruleset.indexed for c in q}
    rows, under, asked, keys = [], set(), set(), set()
    for rule, conditions in ruleset.indexed:
        chosen = max(conditions, key=lambda c: (len(told[c]), c))
        under.add(chosen)
        rest = [(c, v) for c, v in conditions.items() if c != chosen]
        asked.update(c for c, _ in rest)
        keys.add(rule.query_key)
        table = rule.table or "*"
        for value in dict.fromkeys(conditions[chosen]):
            rows.append((f"{chosen}={value}", rule.rule_id, rule.query_key, None if table == "*" else _pattern(table), rest))
    ddl = "_key string, _rule string, _path string, _table string, _rest array<struct<column:string,values:array<string>>>"
    rules = df.sparkSession.createDataFrame(rows, ddl)
    offered = F.array(*[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in sorted(under)])
    found = df.withColumn("_key", F.explode(F.filter(offered, lambda k: k.isNotNull()))).join(rules, "_key")
    texts = [x for c in sorted(asked) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    have = F.create_map(*texts) if texts else F.create_map().cast("map<string,string>")
    rest = F.forall("_rest", lambda c: F.coalesce(F.array_contains(c["values"], F.element_at(have, c["column"])), F.lit(False)))
    there = F.col("_table").isNull()
    if any(row[3] for row in rows):
        there = there | F.regexp_like("_index", F.col("_table"))
    query_key = F.create_map(*[x for k in sorted(keys) for x in (F.lit(k), fields.column(k).cast("string"))])
    hit = F.struct(F.col("_rule").alias("rule_id"), F.element_at(query_key, F.col("_path")).alias("query_key"))
    return found.where(rest & there).withColumn("_hit", hit).select(*df.columns, "_hit")


def rule_errors(df: DataFrame, ruleset: RuleSet, at: Column) -> DataFrame:
    rows = df.sparkSession.createDataFrame(ruleset.errors, "rule_id string, error string")
    return rows.withColumn(TS, at)


def detect(df: DataFrame, rules: Sequence[Rule] | RuleSet, alert_time: Column | None = None, now: Any = None) -> DataFrame:
    """Alert documents ``rule_id, query_key, alert_time, @timestamp, …``, one per (rule, event).

    Every rule is one element of an array expression, so the events are read once for
    any number of rules; many rules that ask for equal values are looked up in an index. The alert carries the event's leaves under ``match_body`` and
    the event's time, falling back to the alert time.
    """
    ruleset = rules if isinstance(rules, RuleSet) else prepare(df, rules, now)
    fields = Fields(df.schema)
    events = df
    if not ruleset.rules:
        df = df.where(F.lit(False))
        hit = F.array(F.struct(F.lit("").alias("rule_id"), F.lit("").alias("query_key")))
    else:
        tests = [
            F.when(
                test,
                F.struct(
                    F.lit(rule.rule_id).alias("rule_id"), fields.column(rule.query_key).cast("string").alias("query_key")
                ),
            )
            for rule, test in ruleset.rules
        ]
        hit = F.filter(F.array(*tests), lambda h: h.isNotNull())
        df = df.where(_any([test for _, test in ruleset.rules]))
    stamp = F.current_timestamp() if alert_time is None else alert_time
    hits = df.withColumn("_hit", F.explode(hit))
    if ruleset.indexed:
        looked_up = _looked_up(events, ruleset, fields)
        hits = hits.unionByName(looked_up) if ruleset.rules else looked_up
    hits = hits.withColumns(
        {
            "rule_id": F.col("_hit.rule_id"),
            "query_key": F.col("_hit.query_key"),
            "alert_time": stamp,
            "event_index": F.col("_index"),
            "event_id": F.col("_id"),
        }
    )
    body = F.transform_keys("fields", lambda k, _: F.concat(F.lit("match_body."), k)) if fields.dynamic else None
    return hits.select(
        F.lit(DETECTIONS).alias("_index"),
        F.concat("rule_id", F.lit("/"), "event_index", F.lit("/"), "event_id").alias("_id"),
        F.to_date(F.coalesce(F.col(TS), "alert_time")).alias("_day"),
        F.coalesce(F.col(TS), "alert_time").alias(TS),
        "alert_time",
        "rule_id",
        F.col("rule_id").alias("rule_name"),
        "query_key",
        "event_index",
        "event_id",
        *([body.alias("fields")] if body is not None else []),
    )


def _any(tests: list[Column]) -> Column:
    """Their disjunction, as a balanced tree so that many rules make no deep expression."""
    while len(tests) > 1:
        tests = [functools.reduce(Column.__or__, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0]


def as_documents(alerts: DataFrame) -> DataFrame:
    """Alerts as documents of the dataset ``detections``, one table a day, for ``Store.write``."""
    own = {
        "rule_id": "rule_id", "rule.name": "rule_name", "query_key": "query_key",
        "event.index": "event_index", "event.id": "event_id", "alert_time": "alert_time",
    }
    leaves = F.create_map(*[x for path, c in own.items() for x in (F.lit(path), to_leaf(F.col(c)))])
    leaves = F.map_filter(leaves, lambda _, v: v != "null")
    if "fields" in alerts.columns:
        leaves = F.map_concat(F.map_filter("fields", lambda k, _: ~k.isin(list(own))), leaves)
    return promote(alerts.select("_id", TS, leaves.alias("fields")), DETECTIONS, F.col(TS), F.col("_id"))


def look_back(df: DataFrame, now: Column, days: int = LOOK_BACK_DAYS) -> DataFrame:
    """Events a rule looks at on its first run."""
    start = now - F.make_dt_interval(days=F.lit(days))
    recent = F.col(TS) >= start
    if "_day" in df.columns:
        recent = recent & (F.col("_day") >= start.cast("date"))
    return df.where(recent)


def unsuppressed(df: DataFrame, signature_ids: Sequence[int], column: str = "alert_signature_id") -> DataFrame:
    """Alerts whose signature is not on a short fixed list; rows without one stay."""
    return df.where(~F.coalesce(F.col(column).isin(list(signature_ids)), F.lit(False)))


def unsuppressed_by(df: DataFrame, suppressed: DataFrame, column: str = "alert_signature_id") -> DataFrame:
    """The same against a table of ids; adaptive execution broadcasts it if it is small."""
    ids = suppressed.select(F.col(suppressed.columns[0]).alias(column)).distinct()
    return df.join(ids, column, "left_anti")
