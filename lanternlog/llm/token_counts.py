"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; runs of ``LEAF`` pre-tokens are the leaves of a
segment tree whose nodes hold sums of characters and tokens. An edit is located by descending the sums;
only the leaves it touches, the one that holds the two characters before it (a pattern looks no further
ahead), and following ones until a new pre-token ends where an old leaf ended, are encoded again. All
later pre-tokens are the same, because the pattern never looks back. Sums change on the paths to the
root only; a tree is laid out anew, without encoding, when its leaves have grown too full.

``build`` gives the trees as a table and ``apply`` brings a table of trees up to date. Trees are arrays,
so they can be stored beside the texts and edited again later.

Defined cases: a null text has an empty tree and stays null unless edited; an edit reaching past the
text is cut to it; edits of a document apply one after the other, each to the text the one before left;
null or empty lists of edits change nothing; repeated rows are edited each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

LEAF, FANOUT, FULL = 64, 16, 8
#: Pre-tokens whose token counts a task remembers at a time.
REMEMBERED = 1 << 19
#: The pattern that goes with the byte-level vocabularies: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_AHEAD = 2


class Encoder:
    """Pre-tokens and their token counts, for one vocabulary of ranks."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of runs of ``LEAF`` pre-tokens."""
        if not pieces:
            return [], []
        starts = np.arange(0, len(pieces), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
        tokens = np.add.reduceat(np.fromiter(map(self.count, pieces), np.int64, len(pieces)), starts)
        return chars.tolist(), tokens.tolist()


class Tree:
    """Sums of characters and tokens; level 0 holds the leaves, each next level sums of ``FANOUT``."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.levels = [(chars, tokens)]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            self.levels.append(tuple([sum(x[k : k + FANOUT]) for k in range(0, len(x), FANOUT)] for x in below))

    @property
    def total(self) -> int:
        top = self.levels[-1][1]
        return top[0] if top else 0

    def locate(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins; the last leaf beyond the end."""
        k, begin = 0, 0
        for chars, _ in reversed(self.levels):
            k *= FANOUT if len(self.levels) > 1 and chars is not self.levels[-1][0] else 1
            last = min(len(chars), k + FANOUT) - 1
            while k < last and begin + chars[k] <= char:
                begin += chars[k]
                k += 1
        return k, begin

    def replace(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """New values for the leaves from ``first`` on, and for the sums above them."""
        a, b = first, first + len(chars)
        self.levels[0][0][a:b], self.levels[0][1][a:b] = chars, tokens
        for below, here in zip(self.levels, self.levels[1:], strict=False):
            a, b = a // FANOUT, (b - 1) // FANOUT + 1
            for part, sums in zip(below, here, strict=True):
                for k in range(a, b):
                    sums[k] = sum(part[k * FANOUT : (k + 1) * FANOUT])


class Edit(NamedTuple):
    start: int
    length: int
    insert: str


def edit(text: str, tree: Tree, change: Edit, encoder: Encoder) -> tuple[str, Tree, int]:
    """The text and tree after one edit, and how many characters were encoded again."""
    start = min(max(change.start, 0), len(text))
    stop = min(start + max(change.length, 0), len(text))
    new = text[:start] + change.insert + text[stop:]
    shift = len(new) - len(text)
    chars, tokens = tree.levels[0]
    if not chars:
        chars, tokens = encoder.leaves(encoder.pattern.findall(new))
        return new, Tree(chars, tokens), len(new)
    first, begin = tree.locate(max(0, start - _AHEAD))
    last, end = first, begin + chars[first]
    while last + 1 < len(chars) and end < stop:
        last += 1
        end += chars[last]
    pieces: list[str] = []
    place = begin
    for m in encoder.pattern.finditer(new, begin):
        # an old leaf ends here, behind the edit: all that follows is as it was
        while last + 1 < len(chars) and end + shift < place:
            last += 1
            end += chars[last]
        if place >= begin and end + shift == place and end >= stop and last + 1 < len(chars):
            break
        pieces.append(m[0])
        place = m.end()
    else:
        last = len(chars) - 1
    n = last - first + 1
    size = max(1, -(-len(pieces) // n))
    if size > FULL * LEAF or not pieces:
        own = encoder.leaves(pieces)
        fresh = [[*old[:first], *mid, *old[last + 1 :]] for old, mid in zip((chars, tokens), own, strict=True)]
        return new, Tree(*fresh), place - begin
    parts = [pieces[k * size : (k + 1) * size] for k in range(n)]
    tree.replace(first, [sum(map(len, p)) for p in parts], [sum(map(encoder.count, p)) for p in parts])
    return new, tree, place - begin


_TREE = "chars array<bigint>, tokens array<bigint>, n_tokens bigint"


def build(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, text, the leaves of its tree (chars, tokens) and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            trees = [encoder.leaves(encoder.pattern.findall(t.as_py() or "")) for t in batch.column(1)]
            kind = pa.list_(pa.int64())
            new = [pa.array([t[k] for t in trees], kind) for k in (0, 1)]
            total = pa.array([sum(t[1]) for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, total], names=["doc_id", "text", "chars", "tokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, {_TREE}")


def apply(trees: DataFrame, edits: Column, ranks: bytes) -> DataFrame:
    """The table of trees after ``edits`` (array of start, length, insert), with n_before and n_reencoded.

    n_before: the tokens before; n_reencoded: the characters that had to be encoded again.
    """
    shared = trees.sparkSession.sparkContext.broadcast(ranks)
    rows = trees.select("doc_id", "text", "chars", "tokens", "n_tokens", edits.cast("array<struct<start:bigint,length:bigint,insert:string>>").alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts, chars, tokens, totals, again = [], [], [], [], []
            for text, own, sizes, changes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 5)), strict=True):
                tree, seen = Tree(own or [], sizes or []), 0
                for e in changes or []:
                    change = Edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                    text, tree, n = edit(text or "", tree, change, encoder)
                    seen += n
                texts.append(text)
                chars.append(tree.levels[0][0])
                tokens.append(tree.levels[0][1])
                totals.append(tree.total)
                again.append(seen)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(chars, kind), pa.array(tokens, kind), pa.array(totals, pa.int64()), batch.column(4), pa.array(again, pa.int64())],
                names=["doc_id", "text", "chars", "tokens", "n_tokens", "n_before", "n_reencoded"],
            )

    kind = trees.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, {_TREE}, n_before bigint, n_reencoded bigint")


def masking_edits(text: Column) -> Column:
    """Edits a cleaning step would make: a heading, a passage in the middle, a closing line.

    Positions are counted in the text as the edits before left it.
    """
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    change = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).cast("bigint").alias("length"), F.lit(insert).alias("insert"))
    middle = F.floor(n / 2).cast("bigint")
    return F.array(
        change(F.lit(0).cast("bigint"), 0, "Title: "), change(middle, 40, " [removed] "), change(n, 0, " 's end\n\n")
    )


def report(docs: DataFrame, ranks: bytes) -> DataFrame:
    """Token counts of every document before and after the edits, and what was encoded again for them."""
    trees = build(docs, ranks)
    done = apply(trees, masking_edits(F.col("text")), ranks)
    return done.select(
        "doc_id",
        F.col("n_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars_edited"),
        "n_reencoded",
    )
