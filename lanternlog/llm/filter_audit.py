"""What each filter of a chain removes, in every order the chain could have.

Every document has a mask: one bit for each filter it fails. Documents of a part (a source) are counted by
mask, at most 2^k cells for k filters. A Gray code then visits all subsets of filters, one filter switched on
or off at a time: each cell counts the filters now on that it fails, and a cell that leaves or reaches zero
takes its documents out of the running survivors or brings them back. The 2^k states so found hold all that
any order of the filters can show: a step's losses are the difference of two states.

Whether a text repeats is decided table-wide, by a SHA-256 digest and the smallest id that has it; rows that
repeat a (id, text, part) are counted together first, so no text, id or part gathers in one task.

Null text and null source are empty. A null id is neither smaller nor larger than another: such a row never
fails for repeating and makes no other row fail. Rows with one id and one text do not repeat each other.
Repeated label rows count once, a label of 1 wins. An empty table has no parts and gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.llm.tables import stored, tidy

#: Parts worked on at once in a task: bounds the rows made from one batch.
PARTS = 64
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPEATS = "E"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column, tokens: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides: short, repetitive, shouting, odd characters."""
    n, capitals = F.size(tokens), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(tokens)) * 100 < n * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(
    docs: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], Mapping[str, Column]] = text_filters
) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the filters they fail; bit i is the i-th filter, the
    last one that of repeated texts."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", words(F.col("text")))
    failing = filters(F.col("text"), F.col("tokens"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failing.values())), F.lit(0))
    narrow = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask"))
    seen = stored(narrow.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "filter-masks")

    # the first holder of each text, found again by (text, id): no join gathers all copies of a text
    first = seen.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # a null id finds no label; it is dealt out by its text
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(*(F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
        .withColumn("apart", F.lit(0).cast("bigint"))
    )
    flagged = (
        seen.join(first.withColumn("leads", F.lit(True)), ["digest", "doc_id"], "left")
        .withColumn("apart", apart)
        .join(marks, ["doc_id", "apart"], "left")
    )
    repeats = F.col("doc_id").isNotNull() & F.col("leads").isNull()
    return (
        flagged.withColumn("mask", F.col("mask") + F.when(repeats, 1 << len(failing)).otherwise(0))
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in MEASURES[1:]))
    )


def survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, from cells [part, mask, measure], as [subset, part, measure]."""
    size = cells.shape[1]
    fails = np.arange(size)
    active = np.zeros(size, np.int64)  # filters now on that each cell fails
    alive = cells.sum(axis=1)
    states = np.empty((size, *alive.shape), np.int64)
    states[0] = alive
    on = 0
    for step in range(1, size):
        toggled = step & -step  # the Gray code's next bit
        on ^= toggled
        cell = fails[fails & toggled != 0]
        if on & toggled:
            alive = alive - cells[:, cell[active[cell] == 0]].sum(axis=1)
            active[cell] += 1
        else:
            active[cell] -= 1
            alive = alive + cells[:, cell[active[cell] == 0]].sum(axis=1)
        states[on] = alive
    return states


def _orders(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every (order, step): the filter's number, and the subset on before it."""
    turn = np.array(list(permutations(range(k)))).reshape(-1, k)
    after = np.cumsum(1 << turn, axis=1)
    return turn.ravel(), (after - (1 << turn)).ravel()


def steps(cells: np.ndarray) -> np.ndarray:
    """The seven counts of every (part, order and step), from cells [part, mask, measure]."""
    k = cells.shape[1].bit_length() - 1
    turn, before = _orders(k)
    states = survivors(cells)
    lost = states[before] - states[before | (1 << turn)]  # [step, part, measure]
    single = 1 << np.arange(k)
    failing = states[0, :, 0] - states[single, :, 0]  # [filter, part]
    shapley = np.zeros_like(failing)
    np.add.at(shapley, turn, lost[:, :, 0])
    removed = lost[:, :, 0]
    unique = cells[:, single, 0].T
    kept = states[before | (1 << turn)][:, :, 0]
    out = [kept, removed, failing[turn] - removed, unique[turn], lost[:, :, 1], lost[:, :, 2], shapley[turn]]
    return np.stack(out).transpose(0, 2, 1)  # [count, part, step]


@tidy
def audit(
    docs: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], Mapping[str, Column]] = text_filters
) -> DataFrame:
    """One row per part, order of the filters and step of the order, with the counts of ``COUNTS``.

    ``filters`` names failure conditions by one letter each; the filter of repeated texts, ``E``, is added.
    """
    names = [*filters(F.lit(""), words(F.lit(""))), REPEATS]
    k = len(names)
    cells = (
        masks(docs, labels, filters)
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most 2^k
    )
    orders = ["".join(p) for p in permutations(names)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                lists = some.column("cells")
                flat = lists.flatten()
                row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                table = np.zeros((some.num_rows, 1 << k, len(MEASURES)), np.int64)
                for i, name in enumerate(MEASURES):
                    table[row, flat.field("mask").to_numpy(), i] = flat.field(name).to_numpy()
                counts = steps(table)
                per = len(orders) * k
                taken = np.repeat(np.arange(some.num_rows), per)
                columns = {
                    "part": some.column("part").take(pa.array(taken)),
                    "filter_order": pa.array(orders * some.num_rows).take(pa.array(np.arange(len(taken)) // k)),
                    "step": pa.array(np.tile(np.arange(1, k + 1), len(taken) // k), pa.int32()),
                }
                yield pa.RecordBatch.from_pydict(columns | {c: pa.array(v.ravel()) for c, v in zip(COUNTS, counts)})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return cells.mapInArrow(walk, schema)
