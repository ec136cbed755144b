"""Display columns: labels, end points, sizes, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions.predicates import Fields
from lanternlog.model import SEVERITY_CODES, TS

NONE = "—"


def select_fields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Source filtering: the listed paths only, one column each."""
    fields = Fields(df.schema)
    return df.select(*[fields.column(p).alias(p.replace(".", "_") if p != TS else TS) for p in paths])


def severity_label(severity: Column, keep_text: bool = True) -> Column:
    """1-4 by name and any other number ``info``; text is lower-cased or, on request, ``info``."""
    text = severity.cast("string")
    number = F.trim(text).try_cast("int")
    label = F.when(text.isNull() | (text == ""), "info")
    for name, code in SEVERITY_CODES.items():
        label = label.when(number == code, name)
    label = label.when(number.isNotNull(), "info")
    return label.otherwise(F.lower(text)) if keep_text else label.otherwise("info")


def first_filled(*columns: Column, default: str = NONE) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def endpoint(ip: Column, port: Column) -> Column:
    """``ip:port``; the port is left out when absent or 0."""
    shown = first_filled(ip)
    return F.when(port.isNotNull() & (port != 0), F.concat(shown, F.lit(":"), port.cast("string"))).otherwise(shown)


def flow_bytes(total: Column, to_server: Column, to_client: Column) -> Column:
    """Reported total, else both directions when the first is known; 0 counts as unknown."""
    return F.coalesce(
        F.when(total != 0, total),
        F.when(to_server != 0, to_server + F.coalesce(to_client, F.lit(0).cast("bigint"))),
    )


def bytes_floor(n: Column) -> Column:
    """Whole units by repeated integer division, ``GB`` being the last unit."""
    k = 1024
    text = lambda value, unit: F.concat(value.cast("string"), F.lit(f" {unit}"))
    step = lambda d: F.floor(n / d).cast("bigint")
    return (
        F.when(n.isNull(), NONE)
        .when(n < k, text(n, "B"))
        .when(n < k**2, text(step(k), "KB"))
        .when(n < k**3, text(step(k**2), "MB"))
        .when(n < k**4, text(step(k**3), "GB"))
        # the loop divides once more after the last unit it knows
        .otherwise(text(step(k**4), "GB"))
    )


def bytes_decimal(n: Column) -> Column:
    """Whole units up to GB, one decimal for TB."""
    k = 1024.0
    whole = lambda d, unit: F.format_string(f"%.0f {unit}", F.bround(n / F.lit(d), 0))
    return (
        F.when(n < k, F.format_string("%.0f B", n.cast("double")))
        .when(n < k**2, whole(k, "KB"))
        .when(n < k**3, whole(k**2, "MB"))
        .when(n < k**4, whole(k**3, "GB"))
        .otherwise(F.format_string("%.1f TB", n / F.lit(k**4)))
    )


def timestamp_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(NONE))


def bar_height(count: Column, partition: Sequence[Column] = ()) -> Column:
    """Percent of the tallest bar, at least 4. Runs over a report of few rows per partition."""
    tallest = F.greatest(F.max(count).over(W.partitionBy(*(partition or [F.lit(0)]))), F.lit(1))
    return F.greatest(F.lit(4), F.floor(count / tallest * 100).cast("int"))


def safe_base(name: Column) -> Column:
    """File name -> dataset name: stem, lower case, runs of other characters to one dash."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    slug = F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "logs").otherwise(slug)


def title_words(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))), ""
    )


def vendor_name(stem: Column) -> Column:
    """Vendor of a log source name: the part before the first dash, in title case."""
    return title_words(F.replace(F.substring_index(stem, "-", 1), F.lit("_"), F.lit(" ")))


def keyword_category(
    vendor: Column,
    rules: Sequence[tuple[str, Sequence[str]]],
    prefixes: Sequence[tuple[str, str]] = (),
    default: str = "Other",
) -> Column:
    """Category of the first rule with a keyword inside the lower-cased vendor name.

    ``rules`` is the caller's ordered keyword table (keywords may carry a trailing
    space); ``prefixes`` holds (prefix, category) tests that go first.
    """
    name = F.lower(vendor)
    label = None
    tests = [(name.startswith(prefix), category) for prefix, category in prefixes]
    for category, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        tests.append((hit, category))
    for hit, category in tests:
        label = F.when(hit, category) if label is None else label.when(hit, category)
    return F.lit(default) if label is None else label.otherwise(default)
