"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanternlog.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node reachable from it (component), for the links a - b (bigints, not null).

    Each round lowers a node's label to the smallest among its neighbours' and then to that label's own
    label, so the number of rounds grows with the logarithm of a component's longest path. Every round
    ends in a written table; labels and links are only ever joined and summed, never collected.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # what the lower label itself points to now
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        step = stored(lower.join(jump, "low").select("node", F.col("label").alias("old"), F.least("low", "jump").alias("label")), "labels")
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")
