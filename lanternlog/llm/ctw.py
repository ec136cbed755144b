"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each is predicted in the contexts of the 0 to ``DEPTH`` bytes before it.
Every node (context, bits so far) holds a Krichevsky-Trofimov estimate, and the context-tree recursion
P_w = (P_e + product of the children's P_w) / 2 weighs all depths against each other. Texts are closed by a
byte that UTF-8 never uses, which also stands before their first byte, so the model is a distribution over
texts of any length.

Counting is a Spark aggregation over all texts: byte (``DEPTH`` + 1)-grams, summed per task and then over
tasks; grams of held-out texts alone count nothing and are there to be priced. The whole tree is weighed, no
node is left out: a gram's bytes are ordered from the one just before it outwards, so the subtree of a
context is a range of grams, and the grams are cut into ranges (``PART`` grams each) that tasks weigh by
themselves. Only contexts that lie across a cut, at most two a depth and range, are finished on the driver
from sums of what each range holds of them; with those, every range gives each of its grams the log10 of its
last byte's probability.

A text's score is the sum of its grams' prices. Beside it stands the add-one unigram score of the same texts.
Neither grams nor words are bounded in number: grams above one in ``2 ** GRAM_HEAD`` of all and words above one
in ``2 ** HEAD`` of all tokens (at most that many of each) are broadcast, the rest are joined.

Defined cases: a null text is empty, an empty text is its end alone; a null id trains and is not held out;
repeated rows each count and each get a row; without training texts every bit has probability 1/2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.llm import bytes as B
from lanternlog.llm.tables import stored, tidy

DEPTH, HEAD, GRAM_HEAD, PART = 5, 21, 23, 1 << 17
_END = 0xFF
_U = np.uint64
_SLOTS = 20
#: Grams and words that a task holds while it counts.
HELD = 1 << 19


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end, the ``DEPTH`` bytes before it, nearest first, and itself as one number; where each text's begin."""
    n, size = len(at) - 1, np.diff(at)
    padded = np.full(len(buf) + DEPTH * (n + 1), _END, np.uint8)
    row = np.repeat(np.arange(n), size)
    padded[np.arange(len(buf)) + DEPTH * (row + 1)] = buf
    base = at[:-1] + DEPTH * (np.arange(n) + 1)
    counted = np.repeat(base - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(len(buf) + n)
    wide = padded.astype(_U)
    key = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= wide[DEPTH - k : DEPTH - k + len(key)] << _U(8 * (DEPTH + 1 - k))
    return key[counted - DEPTH], np.concatenate([[0], np.cumsum(size + 1)])


def _merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, place = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(place, np.concatenate(n), len(values)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """kind ('g' byte grams, 'w' words), key and n over the rows of ``docs`` that are ``learnt``; grams of other rows with 0."""

    def out(kind: str, values: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(values), 1 << 16):
            part = values[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(kind, len(part)), pa.array(part.view(np.int64)), pa.array(n[k : k + (1 << 16)])],
                names=["kind", "key", "n"],
            )

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {"g": ([], []), "w": ([], [])}
        for batch in batches:
            learnt = batch.column(1)
            for kind, rows in (("g", learnt), ("w", learnt), ("unseen", pc.invert(learnt))):
                buf, at = B.utf8(batch.column(0).filter(rows))
                have = held["w" if kind == "w" else "g"]
                for i, j in B.slices(at):
                    own, began = buf[at[i] : at[j]], at[i : j + 1] - at[i]
                    keys = B.word_hashes(own, began, B.GRAPHIC)[0] if kind == "w" else grams(own, began)[0]
                    values, n = np.unique(keys, return_counts=True)
                    have[0].append(values)
                    have[1].append(n * (kind != "unseen"))
                    if len(have[0]) >= 16:
                        values, n = _merged(*have)
                        have[0][:], have[1][:] = [values], [n]
                        if len(values) > HELD:
                            yield from out("w" if kind == "w" else "g", values, n)
                            have[0].clear()
                            have[1].clear()
        for kind, have in held.items():
            if have[0]:
                yield from out(kind, *_merged(*have))

    return docs.select("text", "learnt").mapInArrow(run, "kind string, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_GAMMA = np.array([[math.lgamma(n + shift) for n in range(1 << 12)] for shift in (0.5, 1.0)])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """Natural log of the gamma function at n + 1/2 or n + 1."""
    out = _GAMMA[0 if half else 1][np.minimum(n, _GAMMA.shape[1] - 1)]
    large = np.flatnonzero(n >= _GAMMA.shape[1])
    out[large] = [math.lgamma(x + (0.5 if half else 1.0)) for x in n[large].tolist()]
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(a, True) + _log_gamma(b, True) - math.log(math.pi) - _log_gamma(a + b, False)


def _outer(node: np.ndarray) -> np.ndarray:
    """The same symbol or bits after one context byte less."""
    return ((node >> 16) << 8) | (node & 255)


@dataclass
class Level:
    """Nodes of one depth in order, zeros and ones counted in them, each one's place in the level above.

    ``below`` is the log of what children hold that are not in the level beneath, ``cut`` marks nodes of which
    others hold a part.
    """

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    parent: np.ndarray
    below: np.ndarray
    cut: np.ndarray


def _weigh(levels: list[Level]) -> list[np.ndarray]:
    """The weighting recursion up from the deepest contexts: the share of each node's own estimate, by level."""
    shares: list[np.ndarray] = []
    for depth in range(DEPTH, -1, -1):
        x = levels[depth]
        estimate = _log_kt(x.zeros, x.ones)
        if depth == DEPTH:
            weighted = estimate
            shares.append(np.ones(len(estimate)))
        else:
            y = levels[depth + 1]
            x.below = x.below + np.bincount(y.parent, np.where(y.cut, 0.0, weighted), len(x.node))
            weighted = np.logaddexp(estimate, x.below) - math.log(2)
            shares.append(np.exp(estimate - math.log(2) - weighted))
    return shares[::-1]


Mixed = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mix(levels: list[Level], shares: list[np.ndarray], known: list[tuple[np.ndarray, Mixed]] | None = None) -> list[Mixed]:
    """Down from the root: probability of 0 and of 1 as mixed so far, and the weight left for deeper nodes."""
    out: list[Mixed] = []
    for depth, x in enumerate(levels):
        zero, one, left = (m[x.parent] for m in out[-1]) if depth else (np.zeros(len(x.node)), np.zeros(len(x.node)), np.ones(len(x.node)))
        own, n = left * shares[depth], x.zeros + x.ones + 1
        mixed = (zero + own * (x.zeros + 0.5) / n, one + own * (x.ones + 0.5) / n, left - own)
        if known is not None:
            nodes, values = known[depth]
            place = np.searchsorted(nodes, x.node[x.cut])
            for m, v in zip(mixed, values):
                m[x.cut] = v[place]
        out.append(mixed)
    return out


def _trees(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, list[Level], np.ndarray]]:
    """From a range of grams in order: for each bit of the last byte, the bit's number, its levels and each gram's deepest node."""
    pairs, sums, up = [key], [n], []
    for _ in range(DEPTH):
        values, place = np.unique(_outer(pairs[-1]), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, place, sums[-1])
        pairs.append(values)
        sums.append(total)
        up.append(place)
    pairs, sums, up = pairs[::-1], sums[::-1], up[::-1]
    first, last = key[0] >> 8, key[-1] >> 8
    for j in range(8):
        levels: list[Level] = []
        for depth in range(DEPTH + 1):
            pair, own = pairs[depth], sums[depth]
            bits = pair >> (8 - j)
            begin = np.append(True, bits[1:] != bits[:-1])
            head = np.flatnonzero(begin)
            total = np.add.reduceat(own, head)
            ones = np.add.reduceat(own * ((pair >> (7 - j)) & 1), head)
            context = pair[head] >> 8
            levels.append(
                Level(
                    (context << 8) | ((pair[head] & 255) >> (8 - j)) | (1 << j),
                    total - ones,
                    ones,
                    place[up[depth - 1][head]] if depth else np.zeros(0, np.int64),
                    np.zeros(len(head)),
                    (context == first >> 8 * (DEPTH - depth)) | (context == last >> 8 * (DEPTH - depth)),
                )
            )
            place = np.cumsum(begin) - 1
        yield j, levels, place


def _range(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _cut(rows: pa.Table) -> pa.Table:
    """What a range of grams holds of the nodes whose contexts may go on beyond it."""
    found: list[tuple[np.ndarray, ...]] = []
    for _, levels, _ in _trees(*_range(rows)):
        _weigh(levels)
        for depth, x in enumerate(levels):
            found.append((np.full(x.cut.sum(), depth), x.node[x.cut], x.zeros[x.cut], x.ones[x.cut], x.below[x.cut]))
    return pa.table([np.concatenate(c) for c in zip(*found)], names=["depth", "node", "zeros", "ones", "below"])


def _joined(rows: pa.Table) -> list[tuple[np.ndarray, Mixed]]:
    """By depth: the nodes across cuts, in order, and how they mix. All nodes above one of them are among them."""
    depth, node, zeros, ones, below = (rows.column(c).to_numpy() for c in ("depth", "node", "zeros", "ones", "below"))
    levels: list[Level] = []
    for d in range(DEPTH + 1):
        own = np.flatnonzero(depth == d)
        own = own[np.argsort(node[own])]
        parent = np.searchsorted(levels[-1].node, _outer(node[own])) if d else np.zeros(0, np.int64)
        levels.append(Level(node[own], zeros[own], ones[own], parent, below[own], np.zeros(len(own), bool)))
    return [(x.node, mixed) for x, mixed in zip(levels, _mix(levels, _weigh(levels)))]


def priced(gram_counts: DataFrame) -> DataFrame:
    """key, n and log10 of the probability of the gram's last byte after the bytes before it, for every gram."""
    parts = max(1, -(-gram_counts.count() // PART))
    ranges = stored(gram_counts.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ctw-ranges").groupBy("part")
    sums = ranges.applyInArrow(_cut, "depth bigint, node bigint, zeros bigint, ones bigint, below double").groupBy("depth", "node")
    across = sums.agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    shared = gram_counts.sparkSession.sparkContext.broadcast(_joined(across))

    def price(rows: pa.Table) -> pa.Table:
        key, n = _range(rows)
        out = np.zeros(len(key))
        for j, levels, place in _trees(key, n):
            zero, one, _ = _mix(levels, _weigh(levels), shared.value)[-1]
            out += np.log10(np.where((key >> (7 - j)) & 1, one[place], zero[place]))
        return pa.table([key, n, out], names=["key", "n", "log10"])

    return ranges.applyInArrow(price, "key bigint, n bigint, log10 double")


class _Remembered:
    """Prices of the broadcast grams, those seen lately in a table addressed by hash; others are not a number."""

    def __init__(self, grams: np.ndarray, prices: np.ndarray) -> None:
        self.grams, self.prices = grams, prices
        self.keys = np.full(1 << _SLOTS, np.iinfo(np.uint64).max, _U)
        self.values = np.zeros(1 << _SLOTS)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - _SLOTS)).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            values, place = np.unique(keys[new], return_inverse=True)
            scored = np.full(len(values), np.nan)
            if len(self.grams):
                k = np.minimum(np.searchsorted(self.grams, values), len(self.grams) - 1)
                scored = np.where(self.grams[k] == values, self.prices[k], np.nan)
            out[new] = scored[place]
            slot = ((values * _U(0x9E3779B97F4A7C15)) >> _U(64 - _SLOTS)).astype(np.int64)
            self.keys[slot], self.values[slot] = values, scored  # of two for one slot the last stays
        return out


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _rest(keys: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Per row the different keys that are ``left``, and how often each."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[left]
    order = np.lexsort((keys[left], row))
    row, rare = row[order], keys[left][order]
    head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (rare[1:] != rare[:-1]))) if len(rare) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(rare)))
    list_at = pa.array(np.searchsorted(row[head], np.arange(len(at))), pa.int32())
    return pa.ListArray.from_arrays(list_at, pa.array(rare[head].view(np.int64))), pa.ListArray.from_arrays(list_at, pa.array(times, pa.int64()))


def _scored(rows: DataFrame, grams_at: tuple[np.ndarray, np.ndarray], words_at: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row the broadcast grams' part of the score, the broadcast words' of the base score, and what is left to be joined."""
    shared = rows.sparkSession.sparkContext.broadcast((grams_at, words_at))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_at, (words, worth) = shared.value
        model = _Remembered(*grams_at)
        for batch in batches:
            buf, at = B.utf8(batch.column(1))
            for i, j in B.slices(at):
                own, began = buf[at[i] : at[j]], at[i : j + 1] - at[i]
                keys, first = grams(own, began)
                price = model.log10(keys)
                unpriced = np.isnan(price)
                score = _sums(np.where(unpriced, 0, price), first)
                rare_grams = _rest(keys, first, unpriced)
                hashes, first = B.word_hashes(own, began, B.GRAPHIC)
                k = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
                known = words[k] == hashes if len(words) else np.zeros(len(hashes), bool)
                base = _sums(np.where(known, worth[k] if len(words) else 0, 0), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(first) + 1, pa.int64()),
                        pa.array(np.diff(began), pa.int64()),
                        pa.array(_sums(known.astype(float), first).astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        *_rest(hashes, first, ~known),
                        *rare_grams,
                    ],
                    names=["doc_id", "n_tokens", "n_bytes", "n_head", "base_head", "score_head", "rare", "times", "rare_grams", "gram_times"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("rare", "times", "rare_grams", "gram_times"))
    return rows.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_bytes bigint, n_head bigint, base_head double, score_head double, {lists}"
    )


def _head(rows: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur more than ``bound`` times, in order, and what each is worth."""
    head = rows.where(F.col("n") > bound).select("key", "worth").toArrow()
    keys = head.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    return keys[order], head.column("worth").to_numpy()[order]


def _joined_rest(rows: DataFrame, keys: str, times: str, worth: DataFrame) -> DataFrame:
    """row, n and sum over the keys that were left: how many are known and what they are worth."""
    each = rows.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("w")).select("row", "w.*")
    return each.join(worth, "key").groupBy("row").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("worth")).alias("sum"))


@tidy
def report(docs: DataFrame) -> DataFrame:
    """One row per document: model and unigram score, learnt from the documents that are not held out."""
    learnt = docs.withColumn("learnt", ~held_out(F.col("doc_id"))).select("text", "learnt")
    counted = stored(counts(learnt), "ctw-counts")
    words = counted.where("kind = 'w'").select("key", "n", F.log10(F.col("n") + 1.0).alias("worth"))
    ends = learnt.where("learnt").count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = totals["n"] + ends, totals["v"] + (ends > 0)
    prices = stored(priced(counted.where("kind = 'g'").select("key", "n")), "ctw-prices").withColumnRenamed("log10", "worth")
    few_words, few_grams = n_all >> HEAD, (prices.agg(F.sum("n")).first()[0] or 0) >> GRAM_HEAD
    rows = stored(
        _scored(docs, _head(prices, few_grams), _head(words, few_words)).withColumn("row", F.monotonically_increasing_id()),
        "ctw-scored",
    )
    tail = _joined_rest(rows, "rare", "times", words.where(F.col("n") <= few_words).select("key", "worth"))
    tail = tail.select("row", F.col("n").alias("n_tail"), F.col("sum").alias("base_tail"))
    gram_tail = _joined_rest(rows, "rare_grams", "gram_times", prices.where(F.col("n") <= few_grams).select("key", "worth"))
    gram_tail = gram_tail.select("row", F.col("sum").alias("score_tail"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base_head") + zero("base_tail") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n_all + distinct + 1)
    scored = rows.join(tail, "row", "left").join(gram_tail, "row", "left").withColumn("score", F.col("score_head") + zero("score_tail"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + zero("n_tail") + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        # code length per byte, the end counted as one
        (F.col("score") * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
