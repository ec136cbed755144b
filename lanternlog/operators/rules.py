"""Rule text as a table: catalog, status, search, counts, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.text import strip as _strip
from lanternlog.model import RULE_ACTIONS


def _action(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)


def _option(text: Column, key: str) -> Column:
    """Value of the first ``key:`` up to the next semicolon; null without the key."""
    start = F.instr(text, f"{key}:")
    value = F.substring_index(F.substring(text, start + len(key) + 1, F.length(text)), ";", 1)
    return F.when(start > 0, _strip(value))


def has_error(line: Column) -> Column:
    """An enabled line with an unknown action or without ``msg:``, ``sid:`` or ``rev:``."""
    text = _strip(line)
    enabled = (text != "") & ~text.startswith("#")
    complete = text.contains("msg:") & text.contains("sid:") & text.contains("rev:")
    return enabled & (~_action(text).isin(RULE_ACTIONS) | ~complete)


def catalog(lines: DataFrame) -> DataFrame:
    """Rules of ``(file, line_no, source, line)``: one row per line that is a rule.

    ``status`` is ``disabled`` for commented rules, ``error`` for enabled ones that lack
    a required option, else ``enabled``. Lines with an unknown action or without a
    message have no name to list; ``rule_counts`` still counts their errors.
    """
    text = _strip(F.col("line"))
    disabled = text.startswith("#")
    body = F.when(disabled, _strip(F.regexp_replace(text, "^#+", ""))).otherwise(text)
    out = lines.withColumns({"_body": body, "_disabled": disabled, "_error": has_error(F.col("line"))})
    name = F.btrim(_option(F.col("_body"), "msg"), F.lit('"'))
    listed = out.where(_action(F.col("_body")).isin(RULE_ACTIONS) & ~F.startswith("_body", F.lit("#")))
    return listed.select(
        name.alias("name"),
        F.coalesce(_option(F.col("_body"), "sid"), F.lit("")).alias("sid"),
        F.col("file"),
        F.col("line_no"),
        F.lit("suricata").alias("type"),
        "source",
        F.when(F.col("_disabled"), "disabled").when(F.col("_error"), "error").otherwise("enabled").alias("status"),
        _action(F.col("_body")).alias("action"),
    ).where("name <> ''")


def faulty_lines(lines: DataFrame) -> DataFrame:
    """Every line that counts as an error, also those that the catalog cannot name, and what is wrong with it.

    ``file, line_no, source, action, sid, faults``: ``faults`` names an unknown ``action`` and missing options.
    """
    text = _strip(F.col("line"))
    faults = F.concat_ws(
        ",",
        F.when(~_action(text).isin(RULE_ACTIONS), "action"),
        *[F.when(~text.contains(f"{option}:"), option) for option in ("msg", "sid", "rev")],
    )
    return lines.where(has_error(F.col("line"))).select(
        "file", "line_no", "source", _action(text).alias("action"), _option(text, "sid").alias("sid"), faults.alias("faults")
    )


def search_rules(
    rules: DataFrame, q: str = "", source: str = "", status: str = "", limit: int = 10
) -> tuple[DataFrame, DataFrame]:
    """First ``limit`` rules in file order, and a one-row ``truncated`` frame.

    The name is matched case-insensitively, the id as it is. Without a status the
    enabled rules are meant, complete or not.
    """
    out = rules
    if q:
        needle = q.lower()
        out = out.where(F.lower("name").contains(needle) | F.col("sid").contains(needle))
    if source:
        out = out.where(F.col("source") == source)
    if status in ("disabled", "error"):
        out = out.where(F.col("status") == status)
    else:
        out = out.where(F.col("status") != "disabled")
    ordered = out.orderBy("file", "line_no")
    more = ordered.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return ordered.limit(limit), more


def rule_counts(lines: DataFrame) -> DataFrame:
    """``enabled, disabled, error`` of rule lines, one row from one scan."""
    with_id = F.col("line").contains("sid:")
    commented = _strip(F.col("line")).startswith("#")
    return lines.agg(
        F.count_if(with_id & ~commented).alias("enabled"),
        F.count_if(with_id & commented).alias("disabled"),
        F.count_if(has_error(F.col("line"))).alias("error"),
    )


def rule_hits(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts per catalogued signature, 0 where none fired.

    Alerts are counted per signature before the join, so a signature that fires all the
    time costs one row; the join side is then at most one row per signature.
    """
    fired = (
        alerts.where("alert_signature_id is not null")
        .groupBy(F.col("alert_signature_id").cast("string").alias("sid"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return rules.join(fired, "sid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
