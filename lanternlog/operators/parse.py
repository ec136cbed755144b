"""Per-row parsers as column expressions: CEF, grok, dates, key-value pairs, dispatch.

Every parser keeps the row. A failure leaves the outputs null and fills
``parse_error`` unless an earlier step already did.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.fields import unique_map
from lanternlog.functions.text import rstrip, strip
from lanternlog.model import DATE_FORMATS, TS

Step = Callable[[DataFrame], DataFrame]

# Unique in practice; a message that contains it takes the slower per-group route.
_SEP = "␞"

# The pattern tokens the generated parsers use.
GROK_TOKENS = {
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:?\d{2}(?::?\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?",
    "IP": r"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+)",
    "NUMBER": r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)",
    "WORD": r"\b\w+\b",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "NOTSPACE": r"\S+",
    "URI": r"[A-Za-z][A-Za-z0-9+.-]*://\S+",
    "PATH": r"(?:/[^\s/]*)+|[A-Za-z]:(?:\\[^\s\\]*)+",
}


def set_error(previous: Column, failed: Column, message: str | Column) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.coalesce(previous, F.when(failed, text))


def _error_column(df: DataFrame) -> Column:
    return F.col("parse_error") if "parse_error" in df.columns else F.lit(None).cast("string")


# CEF ---------------------------------------------------------------------------------

_HEADER = ["version", "device_vendor", "device_product", "device_version", "device_event_class_id", "name", "severity"]
_EXTENSION = r"(?U)(\w+)=((?:[^\\=]|\\.)*?)(?=\s+\w+=|$)"


def parse_cef(df: DataFrame, column: str = "line", now: Column | None = None, escaped_pipes: bool = False) -> DataFrame:
    """CEF line -> ``cef`` struct, ``extensions`` map and ``@timestamp``, or ``message`` when it is not CEF.

    The header split ignores backslash escapes unless ``escaped_pipes`` is set.
    """
    df = df.withColumn("_line", rstrip(F.col(column))).where(F.col("_line") != "")
    line = F.col("_line")
    start = F.instr(line, "CEF:")
    body = F.substring(line, start, F.length(line))
    parts = F.split(body, r"(?<!\\)\|" if escaped_pipes else r"\|", 8)
    is_cef = (start > 0) & (F.size(parts) >= 7)
    version = F.trim(F.replace(parts[0], F.lit("CEF:"), F.lit("")))
    header = F.struct(*[(version if i == 0 else parts[i]).alias(n) for i, n in enumerate(_HEADER)])
    tail = F.try_element_at(parts, F.lit(8))
    # One pass finds whole pairs; the key has no "=", so the first one splits them.
    found = F.regexp_extract_all(tail, F.lit(_EXTENSION), F.lit(0))
    pairs = F.transform(
        found,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            strip(F.replace(F.substring(p, F.instr(p, "=") + 1, F.length(p)), F.lit("\\="), F.lit("="))).alias("value"),
        ),
    )
    stamp = F.current_timestamp() if now is None else now
    return (
        df.withColumn("cef", F.when(is_cef, header))
        .withColumn("extensions", F.when(is_cef & tail.isNotNull(), unique_map(pairs)))
        .withColumn("message", F.when(~is_cef, line))
        .withColumn(TS, F.when(is_cef, stamp))
        .drop("_line")
    )


# Grok --------------------------------------------------------------------------------


def grok_regex(pattern: str) -> tuple[str, list[tuple[str, str | None]]]:
    """Expand ``%{TOKEN:name:type}`` to one regex; returns it with (name, type) per group."""
    names: list[tuple[str, str | None]] = []

    def expand(match: re.Match[str]) -> str:
        token, _, rest = match.group(1).partition(":")
        if token not in GROK_TOKENS:
            raise ValueError(f"unknown pattern token {token!r}")
        name, _, kind = rest.partition(":")
        if not name:
            return f"(?:{GROK_TOKENS[token]})"
        names.append((name, kind or None))
        return f"({GROK_TOKENS[token]})"

    # Plain groups of the caller would shift the numbering.
    plain = re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
    return re.sub(r"%\{([^}]+)\}", expand, plain), names


def grok(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Named captures of the first match become columns; no match sets ``parse_error``.

    All groups come from one regex pass that rewrites the line to its captures.
    """
    regex, names = grok_regex(pattern)
    whole = rf"(?s)^.*?(?-s:{regex}).*$"
    text = F.col(column)
    rewritten = F.regexp_replace(text, whole, _SEP + _SEP.join(f"${i + 1}" for i in range(len(names))))
    fast = F.when(F.startswith(rewritten, F.lit(_SEP)), F.split(rewritten, _SEP, -1))
    slow = F.when(
        text.rlike(regex),
        F.array(F.lit(""), *[F.regexp_extract(text, regex, i + 1) for i in range(len(names))]),
    )
    out = df.withColumn("_groups", F.when(text.contains(_SEP), slow).otherwise(fast))
    captured = {}
    for i, (name, kind) in enumerate(names):
        value = F.col("_groups")[i + 1]
        captured[name] = value.try_cast({"int": "bigint", "long": "bigint", "float": "double"}[kind]) if kind else value
    error = set_error(
        _error_column(df),
        F.col("_groups").isNull(),
        F.concat(F.lit("Provided Grok expressions do not match field value: ["), text, F.lit("]")),
    )
    return out.withColumns({**captured, "parse_error": error}).drop("_groups")


def date_value(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses; zone-less text is UTC; null when none does."""
    tries = []
    for fmt in formats:
        if fmt == "ISO8601":
            iso = text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
            tries.append(F.when(iso, F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp")))
        else:
            tries.append(F.try_to_timestamp(text, F.lit(fmt)))
    return F.coalesce(*tries)


def parse_date(df: DataFrame, column: str = "timestamp", formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """``@timestamp`` from a text column; a failure leaves it as it was."""
    parsed = date_value(F.col(column), formats)
    return df.withColumn(TS, F.coalesce(parsed, F.col(TS)) if TS in df.columns else parsed)


def kv_map(text: Column, field_split: str = " ", value_split: str = "=", trim: str = '"') -> Column:
    """Pairs of a text as a map, last duplicate wins; null when a piece has no value (failure)."""
    pieces = F.filter(F.split(text, re.escape(field_split), -1), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.btrim(F.substring_index(p, value_split, 1), F.lit(trim)).alias("key"),
            F.btrim(F.substring(p, F.instr(p, value_split) + len(value_split), F.length(p)), F.lit(trim)).alias("value"),
        ),
    )
    well_formed = F.forall(pieces, lambda p: p.contains(value_split))
    return F.when(well_formed, unique_map(pairs))


def kv(df: DataFrame, column: str, into: str = "kv") -> DataFrame:
    """Adds a map of the pairs in a text column; rows that do not split keep a null map."""
    return df.withColumn(into, kv_map(F.col(column)))


def remove(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns; absent ones are ignored."""
    return df.drop(*columns)


def text_log(df: DataFrame, pattern: str, column: str = "message") -> DataFrame:
    """The standard text parser: grok, date, key-value pairs, clean up.

    Only rows that matched go on to the later steps.
    """
    out = parse_date(grok(df, column, pattern)) if "timestamp" in pattern else grok(df, column, pattern)
    return remove(kv(out, "kvpairs"), ["kvpairs"]) if "kvpairs" in out.columns else out


def rebase_now(df: DataFrame, now: Column) -> DataFrame:
    """Keep the event time in ``event_created`` and set every row to one ingest time."""
    created = F.coalesce(F.col(TS), F.col("event_created")) if "event_created" in df.columns else F.col(TS)
    return df.withColumns({"event_created": created, TS: now})


def shift_to_now(df: DataFrame, now: Column, column: str = TS) -> DataFrame:
    """Move all events so that the earliest falls on ``now``; spacing stays, null stays null."""
    earliest = df.agg(F.min(F.unix_micros(column))).scalar()
    shifted = F.timestamp_micros(F.unix_micros(F.col(column)) + (F.unix_micros(now) - earliest))
    return df.withColumn(column, shifted)


# Dispatch ------------------------------------------------------------------------------


def dispatch(
    df: DataFrame,
    branches: dict[str, dict[str, Column]],
    dataset: str = "event_dataset",
    app_proto: str = "message2_app_proto",
    prefix: str = "suricata.",
) -> DataFrame:
    """Per-dataset columns in one projection.

    ``branches`` maps a dataset to the columns it sets; a dataset without a branch
    passes through. Alert rows also take the branch of their application protocol,
    before their own, and keep their dataset whatever a branch sets.
    """
    alert = prefix + "alert"
    name = F.col(dataset)
    protocol = F.concat(F.lit(prefix), F.lower(F.col(app_proto))) if app_proto in df.columns else F.lit(None)
    targets = {t for columns in branches.values() for t in columns} - {dataset}
    out: dict[str, Column] = {}
    for target in sorted(targets):
        value = F.col(target) if target in df.columns else F.lit(None)
        chain = None
        # The row's own branch outranks the protocol's.
        for test in (lambda b: name == b, lambda b: (name == alert) & (protocol == b)):
            for branch, columns in branches.items():
                if target in columns:
                    hit = test(branch)
                    chain = F.when(hit, columns[target]) if chain is None else chain.when(hit, columns[target])
        out[target] = chain.otherwise(value)
    renamed = None
    for branch, columns in branches.items():
        if dataset in columns and branch != alert:
            hit = name == branch
            renamed = F.when(hit, columns[dataset]) if renamed is None else renamed.when(hit, columns[dataset])
    if renamed is not None:
        out[dataset] = renamed.otherwise(name)
    return df.withColumns(out)


class Pipelines:
    """Named parse steps. Nested unknown names are skipped, a top-level one is an error."""

    def __init__(self, steps: dict[str, Step] | None = None) -> None:
        self.steps = dict(steps or {})

    def hints(self, name: str) -> list[str]:
        """Up to five known names that share most of their letter pairs with ``name``, best first."""
        pairs = lambda text: {text[k : k + 2] for k in range(len(text) - 1)}
        wanted = pairs(name.casefold())

        def likeness(step: str) -> float:
            own = pairs(step.casefold())
            return 2 * len(own & wanted) / max(1, len(own) + len(wanted))

        ranked = sorted((-likeness(step), step) for step in self.steps)
        return [step for likely, step in ranked[:5] if likely <= -0.4]

    def resolve(self, name: str) -> Step:
        if name not in self.steps:
            hints = self.hints(name)
            raise ValueError(f"unknown pipeline {name!r}" + (f"; did you mean {', '.join(hints)}" if hints else ""))
        return self.steps[name]

    def run(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Top-level name first, then the nested ones that exist."""
        out = self.resolve(names[0])(df)
        for name in names[1:]:
            if name in self.steps:
                out = self.steps[name](out)
        return out
