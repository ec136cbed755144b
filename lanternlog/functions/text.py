"""White space the way log readers strip it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space in Unicode text.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return strip(text) == ""
