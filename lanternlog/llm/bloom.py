"""A bounded filter of ids: rows it refuses are certainly not among them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: 64-bit words of the smallest and the largest filter. What is broadcast is 16 MB at most; up to two million ids
#: it holds sixty-four bits for each. Beyond, more and more rows pass, and it only saves less: no row is lost.
LEAST, MOST = 1 << 12, 1 << 21
_BITS = 64


def _place(h: Column, words: int) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(words)), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")


def bits_of(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of 64-bit hashes (bigint) in a written table, for ``within``; sized by its rows."""
    words = LEAST
    wanted = hashes.count() * _BITS // 64
    while words < min(wanted, MOST):
        words *= 2
    word, bit = _place(F.col(column), words)
    bits = hashes.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b"))
    rows = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(words, np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return table


def within(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (int64) may be in the filter; those refused are certainly not."""
    h = hashes.view(np.uint64)
    return (table[h & np.uint64(len(table) - 1)] >> ((h >> np.uint64(40)) & np.uint64(63))) & np.uint64(1) == 1


def test_of(spark: SparkSession, table: np.ndarray) -> Callable[[Column], Column]:
    """``within`` for columns of hashes (bigint). Null is never in the filter."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def inside(h: pd.Series) -> pd.Series:
        return pd.Series(within(shared.value, h.to_numpy()))

    return lambda h: h.isNotNull() & inside(F.coalesce(h, F.lit(0).cast("bigint")))


def filter_of(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for columns of ids: true for every id in the table, and for few others. Null is never in it."""
    hashed = ids.select(F.xxhash64(F.col(column).cast("bigint")).alias("h"))
    inside = test_of(ids.sparkSession, bits_of(hashed, "h"))
    return lambda value: value.isNotNull() & inside(F.xxhash64(value.cast("bigint")))
