"""Benchmark decontamination with suffix arrays over the training text.

The documents are cut into shards (slices of a partition). A task turns the words of its shard into
numbers of the benchmark's vocabulary, sorts the suffixes of the shard by prefix doubling, and looks
every suffix of every benchmark item up in that array by binary search. Neighbouring hits on one
diagonal join to the longest verbatim matches. A document lies whole in one shard, so nothing is
shuffled. Suffixes that reach a word foreign to the benchmark before the shortest window ends cannot
hold a window and are left out of the array (a sparse suffix array; exact).

The benchmark is cut into blocks of about ``block_bytes`` of text. ``AT_ONCE`` of them are broadcast together and
looked up one after another in the words of a shard, which are hashed once; a longer benchmark takes further passes,
with the rows written between, so what a task and the driver hold is bounded however long the benchmark is.

Defined cases: a null or empty text has no words; an item without id, text or words is ignored; rows
of one ``item_id`` are one item; repeated documents each get their row; an empty benchmark leaves
every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanternlog.llm import bytes as B
from lanternlog.llm.tables import stored, tidy

WINDOW = 13
SHARE = 20  # contaminated when one word in this many is hit
AT_ONCE = 8  # blocks of the benchmark in one pass
_WORDS = 1 << 20  # words looked up at once


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; only one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


class Queries:
    """The suffixes of one block of items, as numbers of the block's own vocabulary."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        buf, at = B.utf8(pa.array([t for _, t in items], pa.large_string()))
        hashes, first = B.word_hashes(buf, at, B.ALNUM)
        self.vocabulary = np.unique(hashes)
        ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int64)
        by_words: dict[bytes, set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]]
            if len(own):
                by_words.setdefault(own.tobytes(), set()).add(item)
        self.names = [sorted(x) for x in by_words.values()]
        runs = [np.frombuffer(x, np.int64) for x in by_words]
        self.text = np.concatenate([*(np.append(x, 0) for x in runs), np.zeros(window, np.int64)]).astype(np.int64)
        starts, owner, size, base = [], [], [], 0
        for k, x in enumerate(runs):
            w = min(window, len(x))
            n = len(x) - w + 1
            starts.append(np.arange(base, base + n))
            owner.append(np.full(n, k))
            size.append(np.full(n, w))
            base += len(x) + 1
        none = np.zeros(0, np.int64)
        self.starts, self.owner, self.size = (np.concatenate(x) if x else none for x in (starts, owner, size))
        self.shortest = int(self.size.min()) if len(self.size) else window
        self.longest = max((len(x) for x in runs), default=0)


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by the words from there to the next 0, ``depth`` words at least."""
    rank = np.zeros(len(text) + 2 * depth + 2, np.int64)
    live = np.flatnonzero(text)
    rank[live] = text[live]
    step = 1
    while step < depth:
        key = (rank[live] << 32) | rank[live + step]
        values, number = np.unique(key, return_inverse=True)
        rank[live] = number + 1
        step *= 2
        if len(values) == len(live):
            break
    return at[np.argsort(rank[at], kind="stable")]


def _bounds(text: np.ndarray, sa: np.ndarray, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of the suffix array that begins with its first ``size`` words."""
    width = np.arange(queries.shape[1])
    asked = width < size[:, None]
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(sa))
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) // 2
            there = text[sa[mid][:, None] + width]
            differ = (there != queries[k]) & asked[k]
            first = differ.argmax(1)
            some = differ[np.arange(len(k)), first]
            less = some & (there[np.arange(len(k)), first] < queries[k, first])
            right = less | (~some if upper else False)
            lo[k[right]] = mid[right] + 1
            hi[k[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def search(hashes: np.ndarray, first: np.ndarray, q: Queries) -> list[tuple[np.ndarray, ...]]:
    """(row, word position in the row, suffix number) of every window found in a shard."""
    none = np.zeros(0, np.int64)
    n_rows = len(first) - 1
    if not len(hashes) or not len(q.starts):
        return none, none, none
    text = np.zeros(len(hashes) + n_rows + WINDOW + q.longest, np.int32)
    for a in range(0, len(hashes), _WORDS):
        some = hashes[a : a + _WORDS]
        slot = np.minimum(np.searchsorted(q.vocabulary, some), len(q.vocabulary) - 1)
        row = np.searchsorted(first, np.arange(a, a + len(some)), "right") - 1
        text[np.arange(a, a + len(some)) + row] = np.where(q.vocabulary[slot] == some, slot + 1, 0)  # a 0 after each row
    zeros = np.flatnonzero(text == 0)
    live = np.flatnonzero(text)
    if not len(live):
        return none, none, none
    at = live[zeros[np.searchsorted(zeros, live)] - live >= q.shortest]
    if not len(at):
        return none, none, none
    keep = np.zeros(len(text), bool)
    keep[at] = True
    for _ in range(q.shortest - 1):  # the tails of runs that hold a window
        keep[1:] |= keep[:-1] & (text[1:] != 0)
    width = int(q.size.max())
    sa = suffix_array(np.where(keep, text, 0), at, q.longest)
    asked = q.text[q.starts[:, None] + np.arange(width)]
    lo, hi = _bounds(text, sa, asked, q.size)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    there = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    base = first[:-1] + np.arange(n_rows)
    r = np.searchsorted(base, there, "right") - 1
    return r, there - base[r], which


def _add(blocks: Sequence[Queries], batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the blocks' hits added to n_words, spans, items and longest."""
    names = batch.schema.names
    buf, at = B.utf8(batch.column(names.index("text")))
    n_words, spans, items, longest = [], [], [], []
    had = [batch.column(names.index(x)).to_pylist() for x in ("spans", "items", "longest")]
    for i, j in B.slices(at):
        own, began = buf[at[i] : at[j]], at[i : j + 1] - at[i]
        hashes, first = B.word_hashes(own, began, B.ALNUM)
        n_words.append(np.diff(first))
        by_row: dict[int, tuple[list, set, list]] = {}
        for q in blocks:
            row, pos, which = search(hashes, first, q)
            if not len(row):
                continue
            # the longest verbatim matches: hits of one row and item on one diagonal
            order = np.lexsort((pos, pos - q.starts[which], q.owner[which], row))
            row, pos, which = row[order], pos[order], which[order]
            diagonal = pos - q.starts[which]
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(row) != 0) | (np.diff(q.owner[which]) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                got = by_row.setdefault(int(row[a]), ([], set(), [0]))
                start, end = int(pos[a]), int(pos[b] + q.size[which[b]])
                got[0].append((start, end))
                got[1].update(q.names[q.owner[which[a]]])
                got[2][0] = max(got[2][0], end - start)
        for k in range(j - i):
            s, t, longer = by_row.get(k, ([], (), [0]))
            s = sorted([(x["start"], x["end"]) for x in had[0][i + k]] + s)
            joined: list[list[int]] = []
            for a, b in s:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            spans.append([{"start": a, "end": b} for a, b in joined])
            items.append(sorted({*had[1][i + k], *t}))
            longest.append(max(had[2][i + k], longer[0]))
    new = {
        "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        "items": pa.array(items, pa.list_(pa.int64())),
        "longest": pa.array(longest, pa.int64()),
    }
    return pa.RecordBatch.from_arrays([new.get(x, batch.column(k)) for k, x in enumerate(names)], names=names)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """doc (a struct of the columns to carry), text, n_words, spans, items, longest.

    spans: hit word ranges, merged; items: ids found; longest: words of the longest verbatim match.
    """
    spark = docs.sparkSession
    out = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("doc"),
        docs["text"].alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<bigint>").alias("items"),
        F.lit(0).cast("bigint").alias("longest"),
    )
    schema = out.schema
    blocks = _blocks(benchmark, block_bytes)
    some = list(islice(blocks, AT_ONCE))
    while some:
        shared = spark.sparkContext.broadcast(some)

        @B.released
        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = [Queries(items, window) for items in shared.value]
            for batch in batches:
                yield _add(queries, batch)

        out = out.mapInArrow(add, schema)
        some = list(islice(blocks, AT_ONCE))
        if some:
            out = stored(out, "decontaminated")
    return out


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``matches`` with n_hit and contaminated: some word, and one in ``share`` at least, lies in a window found."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]).cast("bigint"))
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


@tidy
def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: how much of it repeats the benchmark, and which items."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judge(matches(docs, benchmark)).select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "contaminated",
        "longest",
    )


@tidy
def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with.

    Every column rides along in one struct, so no name can clash and no join brings rows back together.
    """
    rest = [c for c in docs.columns if c != "text"]
    clean = judge(matches(docs, benchmark, rest)).where(~F.col("contaminated"))
    return clean.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
