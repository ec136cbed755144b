"""Dotted-path access to documents: flatten, read, write, expand.

Everything here is a column expression over ``map<string,string>`` (path -> JSON
text), so it runs inside the JVM and needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _object(v: Column) -> Column:
    """The variant as a map, or null when it is not an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _expand(parent: Column) -> Column:
    """Entries of an object under their full path; ``inner`` is their own map when they are objects."""
    head = parent["key"]
    return F.transform(
        F.map_entries(parent["inner"]),
        lambda e: F.struct(
            F.when(head == "", e["key"]).otherwise(F.concat(head, F.lit("."), e["key"])).alias("key"),
            e["value"].alias("value"),
            _object(e["value"]).alias("inner"),
        ),
    )


def _is_leaf(entry: Column) -> Column:
    return entry["inner"].isNull() | (F.size(entry["inner"]) == 0)


def _bare(entry: Column) -> Column:
    return F.struct(
        entry["key"].alias("key"), F.coalesce(F.to_json(entry["value"]), F.lit("null")).alias("value")
    )


def _rounds(text: Column) -> Column:
    """As many rounds as a document may need: a level of objects takes five characters of its text or more."""
    return F.sequence(F.lit(1), F.floor(F.length(text) / 5).cast("int") + 1)


def leaf_entries(variant: Column, text: Column | None = None) -> Column:
    """Array of (dotted path, JSON text) of an object variant, null for anything else.

    Arrays stay one leaf. Each round looks into the objects the round before found, and the
    rounds are bounded by the length of the document's own ``text`` (rendered anew if it is not
    given), so objects are followed however deep they lie; rounds without any left do nothing.
    """

    def look(state: Column) -> Column:
        return let(
            F.flatten(F.transform(state["open"], _expand)),
            lambda found: F.struct(
                F.concat(state["leaves"], F.transform(F.filter(found, _is_leaf), _bare)).alias("leaves"),
                F.filter(found, lambda e: ~_is_leaf(e)).alias("open"),
            ),
        )

    def round_(state: Column, _: Column) -> Column:
        return F.when(F.size(state["open"]) == 0, state).otherwise(look(state))

    def walk(inner: Column) -> Column:
        root = F.struct(F.lit("").alias("key"), variant.alias("value"), inner.alias("inner"))
        start = F.struct(
            F.array().cast("array<struct<key:string,value:string>>").alias("leaves"), F.array(root).alias("open")
        )
        done = F.aggregate(
            _rounds(F.to_json(variant) if text is None else text), start, round_, lambda s: F.concat(s["leaves"], F.transform(s["open"], _bare))
        )
        return F.when(inner.isNotNull(), done)

    return let(_object(variant), walk)


def unique_map(entries: Column) -> Column:
    """Map from (key, value) entries where the last duplicate of a key wins."""

    def build(latest_first: Column) -> Column:
        return let(
            F.transform(latest_first, lambda e: e["key"]),
            lambda keys: F.map_from_entries(
                F.when(F.size(F.array_distinct(keys)) == F.size(keys), latest_first).otherwise(
                    F.filter(latest_first, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
                )
            ),
        )

    return let(F.reverse(entries), build)


def flatten(variant: Column, text: Column | None = None) -> Column:
    """Object variant -> map of dotted path to JSON text; null for a non-object.

    A nested path and a literal dotted key of the same spelling meet in one key.
    """
    return unique_map(leaf_entries(variant, text))


def to_leaf(value: Any) -> Column:
    """JSON text of a Python value or of a column of any type (null -> ``null``)."""
    if not isinstance(value, Column):
        return F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
    return F.coalesce(F.to_json(value.cast("variant")), F.lit("null"))


def from_leaf(leaf: Column, dtype: str = "string") -> Column:
    """Value of a JSON-text leaf; null when missing, null or not of that type."""
    variant = F.try_parse_json(leaf)
    if dtype == "array<string>":
        # A lone scalar is a one-element list.
        return F.coalesce(
            F.try_variant_get(variant, "$", dtype),
            F.when(F.try_variant_get(variant, "$", "string").isNotNull(), F.array(F.try_variant_get(variant, "$", "string"))),
        )
    return F.try_variant_get(variant, "$", dtype)


def is_under(path: Column, ancestor: Column) -> Column:
    """``path`` lies strictly below ``ancestor``."""
    # The prefix test alone turns down nearly every pair, without building a string.
    return F.startswith(path, ancestor) & (F.substring(path, F.length(ancestor) + 1, F.lit(1)) == ".")


def state_of(fields: Column, path: Column) -> Column:
    """``struct(exists, value)`` of a path; an object value is its JSON text."""

    def state(below: Column) -> Column:
        nested = F.transform(
            F.map_entries(below),
            lambda e: F.struct(
                F.substring(e["key"], F.length(path) + 2, F.length(e["key"])).alias("key"), e["value"].alias("value")
            ),
        )
        value = F.when(F.map_contains_key(fields, path), fields[path]).when(F.size(below) > 0, _nest(nested))
        return let(value, lambda v: F.struct(v.isNotNull().alias("exists"), v.alias("value")))

    return let(F.map_filter(fields, lambda k, _: is_under(k, path)), state)


def drop_paths(fields: Column, paths: list[str]) -> Column:
    """Remove each path and everything below it; absent ones are ignored."""

    def kept(key: Column) -> Column:
        hit = F.lit(False)
        for path in paths:
            hit = hit | (key == F.lit(path)) | F.startswith(key, F.lit(path + "."))
        return ~hit

    return F.map_filter(fields, lambda k, _: kept(k))


def set_constants(fields: Column, values: dict[str, Any]) -> Column:
    """Set whole paths, replacing what was at or below them."""
    added = F.create_map(*[x for path, v in values.items() for x in (F.lit(path), to_leaf(v))])
    return F.map_concat(drop_paths(fields, list(values)), added)


def _quote(text: Column) -> Column:
    return to_leaf(text)


def _members(entries: Column) -> Column:
    """Comma-joined ``"key":value`` text, by key."""
    return F.array_join(
        F.transform(F.array_sort(entries), lambda e: F.concat(to_leaf(e["key"]), F.lit(":"), e["value"])), ","
    )


def _nest(entries: Column) -> Column:
    """JSON object text of (dotted key, JSON text) entries, folding the deepest level first."""
    dots = F.transform(entries, lambda e: F.length(e["key"]) - F.length(F.translate(e["key"], ".", "")))
    deepest = F.coalesce(F.array_max(dots), F.lit(0))
    levels = F.when(deepest > 0, F.sequence(deepest, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    plain = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    top = F.aggregate(levels, plain, _fold_level)
    return F.concat(F.lit("{"), _members(top), F.lit("}"))


def _fold_level(entries: Column, level: Column) -> Column:
    """Merge keys with more than ``level`` segments into one object per ``level``-segment prefix."""

    def prefix(entry: Column) -> Column:
        return F.call_function("substring_index", entry["key"], F.lit("."), level)

    def fold(head: Column) -> Column:
        below = F.filter(entries, lambda e: is_under(e["key"], head))
        tail = F.transform(
            below,
            lambda e: F.struct(
                F.substring(e["key"], F.length(head) + 2, F.length(e["key"])).alias("key"), e["value"].alias("value")
            ),
        )
        return F.struct(head.alias("key"), F.concat(F.lit("{"), _members(tail), F.lit("}")).alias("value"))

    flat = F.filter(entries, lambda e: e["key"] == prefix(e))
    deep = F.filter(entries, lambda e: e["key"] != prefix(e))
    heads = F.array_distinct(F.transform(deep, prefix))
    return F.concat(flat, F.transform(heads, fold))


def expand_fields(fields: Column) -> Column:
    """Dotted leaf map -> nested JSON object text; used where documents leave the system."""
    return _nest(F.map_entries(fields))
