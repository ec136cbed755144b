"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of terms: its overlapping byte trigrams, hashed, one term for its length class and
one for the class of the share of words that repeat the word before them.
From a bounded sample of labelled documents (``PER_CLASS`` of each label, those of smallest hashed id)
the driver learns term weights and a truncated singular value decomposition. The projection and the
labelled vectors, whose sizes those parameters bound, are broadcast; every document is then scored in
one pass: a block of documents is projected, multiplied with all labelled vectors, and the labels of
its nearest ones vote with weights that grow with the cosine. Votes are weighted back to the shares
that the labels have among all labelled training rows, so a score estimates a probability.

Defined cases: an empty or null text is a document that has its classes but no trigrams; a document
that is similar to no labelled one gets the share of label 1; without any labelled row every score is
0.5; labels that are null, and labels of unknown documents, are not used; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.llm import bytes as B

PER_CLASS = 2048
TERMS, LENGTHS, REPEATS, RANK = 4096, 32, 8, 64
#: Weight of a class term beside the trigrams, whose vector has length 1.
BY_LENGTH, BY_REPEATS = 0.15, 0.8
NEIGHBOURS, SHARPNESS = 25, 4
ACCEPT = 0.7
_BLOCK = 256


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def counts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Term counts, one row per text."""
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, TERMS + LENGTHS + REPEATS), np.float32)
    for a in range(0, len(buf) - 2, B.SLICE):  # a long text in pieces that overlap by two bytes
        b = buf[a : a + B.SLICE + 2].astype(np.uint32)
        gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        term = ((gram * np.uint32(2654435761)) >> np.uint32(32 - TERMS.bit_length() + 1)).astype(np.int64)
        row = np.searchsorted(at, np.arange(a, a + len(b)), "right") - 1
        own = row[:-2] == row[2:]
        out[:, :TERMS] += np.bincount(row[:-2][own] * TERMS + term[own], minlength=n * TERMS).reshape(n, TERMS)
    length = np.minimum(np.ceil(np.log2(size + 1)).astype(np.int64), LENGTHS - 1)
    out[np.arange(n), TERMS + length] = 1
    words, first = B.word_hashes(buf, at, B.GRAPHIC)
    again = np.zeros(len(words) + 1, np.int64)
    again[1:-1] = words[1:] == words[:-1]
    again[first[:-1]] = 0  # a text's first word repeats none of its own
    again = np.cumsum(np.append(0, again[:-1]))
    share = (again[first[1:]] - again[first[:-1]]) / np.maximum(np.diff(first), 1)
    out[np.arange(n), TERMS + LENGTHS + np.minimum((share * 3 * REPEATS).astype(np.int64), REPEATS - 1)] = 1
    out[:, TERMS + LENGTHS] = 0  # the class of hardly any repeats is no term
    return out


def features(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Trigram counts, damped, weighted and scaled to length 1, beside the weighted classes."""
    out = np.log1p(x[:, :TERMS]) * weight
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    lengths, repeats = x[:, TERMS : TERMS + LENGTHS], x[:, TERMS + LENGTHS :]
    return np.hstack([out, lengths * np.float32(BY_LENGTH), repeats * np.float32(BY_REPEATS)])


def blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of at most ``_BLOCK`` texts at a time."""
    buf, at = B.utf8(column)
    for i, j in B.slices(at):
        for k in range(i, j, _BLOCK):
            end = min(j, k + _BLOCK)
            yield counts(buf[at[k] : at[end]], at[k : end + 1] - at[k])


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank, unit length
    labels: np.ndarray
    votes: np.ndarray  # what each labelled document's vote is worth
    share: float  # of label 1

    def project(self, x: np.ndarray) -> np.ndarray:
        v = features(x, self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), self.share)
        cosine = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        worth = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS * self.votes[near]
        total = worth.sum(1)
        some = total > 1e-9
        voted = (worth * self.labels[near]).sum(1) / np.where(some, total, 1)
        return np.clip(np.where(some, voted, self.share), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from ``labels.quality`` of the documents that are not held out."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    picked = None
    for label in total:
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    none = np.zeros((0, RANK), np.float32)
    if picked is None:
        flat = np.zeros((TERMS + LENGTHS + REPEATS, RANK), np.float32)
        return Model(flat[:TERMS, 0], flat, none, none[:, 0], none[:, 0], share)

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in blocks(batch.column(0)) for r in x]
            terms = pa.array([np.flatnonzero(r) for r in rows], pa.list_(pa.int32()))
            times = pa.array([r[r > 0].astype(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), terms, times], names=["label", "terms", "times"])

    # at most per_class ids of either label are broadcast; of the rows of one id the smallest text is learnt from
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "label")
    sample = texts.select("text", "label").mapInArrow(run, "label int, terms array<int>, times array<bigint>").toArrow()
    y = sample.column("label").to_numpy().astype(np.float32)
    x = np.zeros((len(y), TERMS + LENGTHS + REPEATS), np.float32)  # a bounded sample: at most 2 per_class rows
    for row, terms, times in zip(x, sample.column("terms"), sample.column("times"), strict=True):
        row[terms.values.to_numpy()] = times.values.to_numpy()
    del sample
    weight = (np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(0))) + 1).astype(np.float32)
    z = x
    for k in range(0, len(x), _BLOCK):
        z[k : k + _BLOCK] = features(x[k : k + _BLOCK], weight)
    # truncated singular value decomposition by subspace iteration
    axes = np.random.default_rng(7).standard_normal((z.shape[1], RANK)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(z.T @ (z @ axes))
    votes = np.array([total[int(k)] / max(1, (y == k).sum()) for k in y])
    vectors = z @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(weight, axes, vectors, y, votes / votes.max(), share)


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """doc (a struct of the columns to carry) and score, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"), docs["text"].alias("text"))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scores(x) for x in blocks(batch.column(1))]
            values = pa.array(np.concatenate(got) if got else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=["doc", "text", "score"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, text string, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select(
        F.col("doc.doc_id").alias("doc_id"),
        held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns they came with."""
    rest = [c for c in docs.columns if c != "text"]
    good = score(docs, fit(docs, labels), rest).where(F.col("score") >= ACCEPT)
    return good.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
