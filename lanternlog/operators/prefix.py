"""Running sums in parallel: a key of any size is many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from lanternlog.session import checkpointed


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "running") -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys up to and including each, in the given order.

    Two passes over range-partitioned rows: the sum of each key in each range, whose running sums over the ranges
    are small, then the running sum inside each range. No task holds more of a key than one range has. Rows that
    tie are counted one after the other in some order. Null keys are keys.
    """
    # written once: both passes must see the same ranges
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    local = ranged.withColumn("_local", F.sum(value).over(inside))
    return local.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_local")).alias(out))
