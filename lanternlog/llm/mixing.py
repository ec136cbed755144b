"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree domain - language - source. The token budget flows from the root down: the
children of a node share its budget by their weights; a child that cannot use its share (its documents
times ``max_epochs``) takes what it can and its siblings share the rest. As a node never gets more than
its leaves can give, a shortage is met by siblings first and by the ancestors' siblings only when the
siblings are used up. Each leaf then gives whole epochs and, of one more, the documents that fit into
the rest of its budget, in an order drawn from seed, epoch and id.

The running sum of that order is taken in two steps, so that a source with a third of all rows stays
spread: tokens by (leaf, slice of the order), a running sum over the slices, and a running sum over
documents only in the one slice of each leaf where its budget ends. All arithmetic is on integers.

Defined cases: a null level is the name ''; a null or empty text has no tokens and such a document is
never selected; repeated rows count each; a child of weight 0 gets nothing; an empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.llm.tables import stored, tidy

LEVELS = ("domain", "lang", "source")
#: Weights by level and name; names not listed weigh 1.
WEIGHTS: tuple[Mapping[str, int], ...] = ({"domain0": 4, "domain1": 2}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})
SEED, MAX_EPOCHS, BUDGET_PARTS = 20, 3, 2  # budget: all tokens divided by BUDGET_PARTS
_SLICE = 4  # hex digits of the order that name a slice


def domain_of(source: Column) -> Column:
    """The test tables name no domain: one of four by the number of the source."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("bigint")


def _weight(level: int, weights: Sequence[Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("bigint")
    for name, w in weights[level].items():
        out = F.when(F.col(LEVELS[level]) == name, F.lit(w).cast("bigint")).otherwise(out)
    return out


def budgets(leaves: DataFrame, budget_parts: int, max_epochs: int, weights: Sequence[Mapping[str, int]]) -> DataFrame:
    """Leaves (levels, tokens) with the tokens that each is to give."""
    for level in range(len(LEVELS)):
        leaves = leaves.withColumn(f"w{level}", _weight(level, weights))
    leaves = leaves.withColumn("cap", F.when(F.least("w0", "w1", "w2") > 0, F.col("tokens") * max_epochs).otherwise(0))
    total = leaves.agg(F.expr(f"sum(tokens) div {int(budget_parts)}").alias("want"), F.sum("cap").alias("cap"))
    given = total.select(F.coalesce(F.least("want", "cap"), F.lit(0)).alias("given"))
    node = given.withColumn("_all", F.lit(1))
    for level in range(len(LEVELS)):
        up, here = ["_all", *LEVELS[:level]], ["_all", *LEVELS[: level + 1]]
        children = leaves.withColumn("_all", F.lit(1)).groupBy(*here).agg(F.sum("cap").alias("cap"), F.max(f"w{level}").alias("w"))
        node = _share(children.where("w > 0").join(node, up), up, LEVELS[level])
    return leaves.join(node.drop("_all"), list(LEVELS), "left").select(
        *LEVELS, "tokens", F.coalesce("given", F.lit(0)).cast("bigint").alias("given")
    )


def _share(children: DataFrame, up: list[str], name: str) -> DataFrame:
    """Divide each parent's ``given`` among its children: by weight, none above its cap."""
    order = Window.partitionBy(*up).orderBy(F.col("cap") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = children.withColumn("_rest", rest).withColumn("_w", F.sum("w").over(onward))
    # children that cannot use their share come first; at the first that can, rest and weight fix the price
    ranked = ranked.withColumn("_full", F.col("cap") * F.col("_w") <= F.col("w") * F.col("_rest"))
    whole = Window.partitionBy(*up)
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("w"), name, "_rest", "_w"))).over(whole)
    ranked = ranked.withColumn("_at", first)
    part = F.expr("(w * _at._rest) div _at._w")
    return ranked.select(*up, name, F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("bigint").alias("given"))


@tidy
def mix(
    docs: DataFrame,
    domain: Column | None = None,
    weights: Sequence[Mapping[str, int]] = WEIGHTS,
    budget_parts: int = BUDGET_PARTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (how often the mix holds it), selected documents only."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    counted = stored(
        docs.select(
            "doc_id",
            (domain if domain is not None else domain_of(name(docs["source"]))).alias("domain"),
            name(docs["lang"]).alias("lang"),
            name(docs["source"]).alias("source"),
            tokens(docs["text"]).alias("n_tokens"),
        ),
        "mix-counted",
    ).where("n_tokens > 0")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, budget_parts, max_epochs, weights).where("given > 0")
    plan = stored(
        plan.select(*LEVELS, F.expr("given div tokens").alias("epochs"), (F.col("given") % F.col("tokens")).alias("rest")),
        "mix-plan",
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = counted.join(plan, list(LEVELS)).withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, _SLICE))
    slices = drawn.groupBy(*LEVELS, "rest", "_slice").agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_slice"))
    # the first slice whose tokens do not fit any more
    ends = slices.withColumn("_upto", upto).where("_upto > rest")
    ends = stored(
        ends.groupBy(*LEVELS).agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_n")).alias("before"))).alias("end")),
        "mix-ends",
    )
    drawn = drawn.join(ends, list(LEVELS))
    cut = drawn.where(F.col("_slice") == F.col("end._slice"))
    run = F.sum("n_tokens").over(
        Window.partitionBy(*LEVELS).orderBy("_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = cut.withColumn("_in", (F.col("end.before") + run <= F.col("rest")).cast("int"))
    others = drawn.where(F.col("_slice") != F.col("end._slice"))
    others = others.withColumn("_in", (F.col("_slice") < F.col("end._slice")).cast("int"))
    return (
        cut.unionByName(others)
        .select("doc_id", *LEVELS, "n_tokens", (F.col("epochs") + F.col("_in")).cast("bigint").alias("copies"))
        .where("copies > 0")
    )
