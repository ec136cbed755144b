"""Filter objects (nested dicts) -> boolean columns.

``Fields`` maps a dotted path to a promoted column when the frame has one, and to
the leaf map otherwise. Predicates on promoted columns stay plain comparisons, so
Catalyst pushes them to the scan; a missing value never matches.
"""

from __future__ import annotations

import datetime as dt
import functools
import logging
import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from lanternlog.functions import net
from lanternlog.functions.fields import from_leaf
from lanternlog.model import SEVERITY_CODES, TS, column_of

log = logging.getLogger(__name__)

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


class Fields:
    """Where the paths of a frame live."""

    def __init__(self, schema: StructType) -> None:
        self.types = {f.name: f.dataType for f in schema.fields}
        self.dynamic = "fields" in self.types

    def promoted(self, path: str) -> str | None:
        for name in (path, column_of(path)):
            if name in self.types:
                return name
        return None

    def column(self, path: str) -> Column:
        name = self.promoted(path)
        if name is not None:
            return F.col(f"`{name}`")
        if self.dynamic:
            return from_leaf(F.col("fields")[path])
        # An unmapped path matches nothing, as in a table that never saw the field.
        return F.lit(None).cast("string")

    def values(self, path: str) -> Column | None:
        """The path as an array, when it can hold several values."""
        name = self.promoted(path)
        if name is not None:
            return F.col(f"`{name}`") if isinstance(self.types[name], ArrayType) else None
        return from_leaf(F.col("fields")[path], "array<string>") if self.dynamic else None

    def text(self) -> list[Column]:
        """Every searchable column, as text."""
        out = []
        for name, dtype in self.types.items():
            if name.startswith("_") or name == TS:
                continue
            column = F.col(f"`{name}`")
            if name == "fields":
                out.append(F.concat_ws(" ", F.map_values(column)))
            elif isinstance(dtype, ArrayType):
                out.append(F.concat_ws(" ", column))
            else:
                out.append(column.cast("string"))
        return out


def compile_filter(df: DataFrame, query: dict[str, Any] | None, now: Any = None) -> Column:
    """Filter object -> boolean column for ``df``. Empty or ``None`` matches everything.

    ``now`` anchors date math (``now-60m``): a datetime, a column (for example a scalar
    subquery) or, by default, the query's start time.
    """
    if not query:
        return F.lit(True)
    return _compile(query, Fields(df.schema), F.current_timestamp() if now is None else _literal(now))


def where(df: DataFrame, query: dict[str, Any] | None, now: Any = None) -> DataFrame:
    return df if not query else df.where(compile_filter(df, query, now))


def validate_filter(df: DataFrame, query: Any) -> None:
    """Raise ``ValueError`` unless the filter is a non-empty object that analyses on ``df``."""
    if not isinstance(query, dict):
        raise ValueError("filter must be an object")
    if not query:
        raise ValueError("filter object cannot be empty")
    try:
        df.where(compile_filter(df, query)).schema  # analysis only, no job
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"filter does not analyse: {error}") from error


def severity_filter(name: str) -> dict[str, Any] | None:
    """Severity by name; an unknown name filters nothing."""
    if not name:
        return None
    if name not in SEVERITY_CODES:
        log.warning("unknown severity %r ignored", name)
        return None
    return {"term": {"alert.severity": SEVERITY_CODES[name]}}


def all_of(*queries: dict[str, Any] | None) -> dict[str, Any]:
    must = [q for q in queries if q]
    return {"bool": {"must": must}} if must else {"match_all": {}}


def contains_text(needle: str, *columns: Column, fold: bool = True) -> Column:
    """Substring test over joined columns, case-insensitive unless ``fold`` is off."""
    joined = F.concat_ws(" ", *columns)
    return F.lower(joined).contains(needle.lower()) if fold else joined.contains(needle)


def words_match(text: Column, words: list[str], op: str) -> Column:
    """Whole-word search in lower-cased text; ``op`` is ``and`` or ``or``."""
    haystack = F.lower(text)
    hits = [haystack.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){_regex_literal(w.lower())}([^\p{{L}}\p{{N}}_]|$)") for w in words]
    return functools.reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), hits)


def parse_date_math(text: str, now: Column) -> Column:
    """``now``, ``now-60m``, ``now+1d`` or an ISO instant (zone-less means UTC)."""
    match = re.fullmatch(r"now(?:([+-])(\d+)([smhdw]))?", text)
    if match:
        if not match.group(1):
            return now
        seconds = int(match.group(2)) * _UNITS[match.group(3)]
        return now + F.make_dt_interval(secs=F.lit(seconds if match.group(1) == "+" else -seconds))
    return _literal(_instant(text))


def _instant(text: str) -> dt.datetime:
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def _literal(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return F.lit(value)


def _regex_literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def _compile(query: dict[str, Any], fields: Fields, now: Column) -> Column:
    if len(query) != 1:
        raise ValueError(f"expected one clause, got {sorted(query)}")
    kind, body = next(iter(query.items()))
    handler = _CLAUSES.get(kind)
    if handler is None:
        raise ValueError(f"unknown clause {kind!r}")
    return handler(body, fields, now)


def _one(body: dict[str, Any]) -> tuple[str, Any]:
    if not isinstance(body, dict) or len(body) != 1:
        raise ValueError("clause needs exactly one field")
    return next(iter(body.items()))


def _match_all(body: Any, fields: Fields, now: Column) -> Column:
    return F.lit(True)


def _equals(path: str, value: Any, fields: Fields) -> Column:
    array = fields.values(path)
    if path.endswith(".ip") and isinstance(value, str) and "/" in value:
        return net.cidr(fields.column(path), value)
    if array is not None:
        return F.array_contains(array, str(value) if not isinstance(value, bool) else str(value).lower())
    if fields.promoted(path) is None:
        text = fields.column(path) == F.lit(str(value).lower() if isinstance(value, bool) else str(value))
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return text | F.coalesce(fields.column(path).try_cast("double") == F.lit(float(value)), F.lit(False))
        return text
    return fields.column(path) == F.lit(_fitting(value, path, fields))


def _fitting(value: Any, path: str, fields: Fields) -> Any:
    """The literal in the type of its typed column, so that no row can fail on the comparison."""
    kind = str(fields.types.get(fields.promoted(path) or "", ""))
    if kind.startswith(("Integer", "Long", "Short", "Double")) and isinstance(value, (str, bool)):
        try:
            return float(value) if kind.startswith("Double") else int(value)
        except ValueError:
            raise ValueError(f"{value!r} is no number, {path!r} holds numbers") from None
    if kind.startswith("String") and not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else str(value)
    return value


def _term(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path, value = _one(body)
    if isinstance(value, dict):
        value = value["value"]
    return _equals(path, value, fields)


def _terms(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path, values = _one(body)
    array = fields.values(path)
    if array is not None:
        return F.arrays_overlap(array, F.array(*[F.lit(str(v)) for v in values]))
    if fields.promoted(path) is None:
        return functools.reduce(lambda a, b: a | b, [_equals(path, v, fields) for v in values], F.lit(False))
    return fields.column(path).isin([_fitting(v, path, fields) for v in values])


def _range(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path, bounds = _one(body)
    column = fields.column(path)
    dynamic = fields.promoted(path) is None
    timed = path == TS or str(fields.types.get(fields.promoted(path) or "", "")).startswith("Timestamp")
    tests: list[Column] = []
    for op, value in bounds.items():
        # a dynamic path has no type of its own: the bound says what it is compared as
        kind = _bound_kind(value) if dynamic else "time" if timed and isinstance(value, str) else "plain"
        if kind == "time":
            edge = parse_date_math(value, now)
            tests.append(_compare(column.try_cast("timestamp") if dynamic else column, op, edge))
        elif kind == "number":
            edge = F.lit(float(value))
            tests.append(_compare(column.try_cast("double"), op, edge))
        else:
            edge = _literal(value if dynamic or timed else _fitting(value, path, fields))
            tests.append(_compare(column, op, edge))
        if path == TS and "_day" in fields.types:
            # Catalyst cannot infer the partition bound from the event-time bound.
            day = F.col("_day")
            tests.append(day >= edge.cast("date") if op in ("gt", "gte") else day <= edge.cast("date"))
    if not tests:
        raise ValueError(f"range on {path!r} has no bound")
    return functools.reduce(lambda a, b: a & b, tests)


def _bound_kind(value: Any) -> str:
    """What a bound on a dynamic path means: a ``number``, a ``time`` or ``plain`` text."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return "plain"
    try:
        float(value)
        return "number"
    except ValueError:
        pass
    if re.match(r"now([+-]|$)", value):
        return "time"
    try:
        _instant(value)
        return "time"
    except ValueError:
        return "plain"


def _compare(column: Column, op: str, edge: Column) -> Column:
    match op:
        case "gt":
            return column > edge
        case "gte":
            return column >= edge
        case "lt":
            return column < edge
        case "lte":
            return column <= edge
    raise ValueError(f"unknown range bound {op!r}")


def _exists(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path = body["field"]
    if fields.promoted(path) is not None:
        column = fields.column(path)
        array = fields.values(path)
        return column.isNotNull() if array is None else column.isNotNull() & (F.size(column) > 0)
    if not fields.dynamic:
        return F.lit(False)
    # A null leaf is present for the audit trail but does not "exist" for a search.
    leaves = F.col("fields")
    return F.exists(
        F.map_entries(leaves),
        lambda e: ((e["key"] == F.lit(path)) | F.startswith(e["key"], F.lit(path + "."))) & (e["value"] != "null"),
    )


def _wildcard(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path, pattern = _one(body)
    regex = "".join(".*" if c == "*" else "." if c == "?" else _regex_literal(c) for c in pattern)
    array = fields.values(path)
    if array is not None:
        return F.exists(array, lambda v: v.rlike(f"(?s)^{regex}$"))
    column = fields.column(path).cast("string")
    if re.fullmatch(r"[^*?]*\*", pattern):
        return column.startswith(pattern[:-1])  # pushes down
    return column.rlike(f"(?s)^{regex}$")


def _cidr(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    path, network = _one(body)
    networks = [network] if isinstance(network, str) else list(network)
    return net.cidr_any(fields.column(path), networks)


def _search(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    words = body["query"].split()
    if not words:
        return F.lit(True)
    chosen = body.get("fields")
    columns = [fields.column(p).cast("string") for p in chosen] if chosen else fields.text()
    return words_match(F.concat_ws(" ", *columns), words, body.get("operator", "or").lower())


def _bool(body: dict[str, Any], fields: Fields, now: Column) -> Column:
    unknown = set(body) - {"must", "filter", "must_not", "should", "minimum_should_match"}
    if unknown:
        raise ValueError(f"unknown bool parts {sorted(unknown)}")

    def clauses(part: str) -> list[Column]:
        value = body.get(part, [])
        return [_compile(q, fields, now) for q in ([value] if isinstance(value, dict) else value)]

    required = clauses("must") + clauses("filter")
    tests = list(required)
    tests += [~F.coalesce(c, F.lit(False)) for c in clauses("must_not")]
    should = clauses("should")
    need = body.get("minimum_should_match", 0 if required or not should else 1)
    if should and need == 1:
        tests.append(functools.reduce(lambda a, b: a | b, should))
    elif should and need > 1:
        hits = [F.coalesce(c, F.lit(False)).cast("int") for c in should]
        tests.append(functools.reduce(lambda a, b: a + b, hits) >= need)
    return functools.reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


_CLAUSES = {
    "match_all": _match_all,
    "term": _term,
    "terms": _terms,
    "range": _range,
    "exists": _exists,
    "wildcard": _wildcard,
    "cidr": _cidr,
    "search": _search,
    "bool": _bool,
}
