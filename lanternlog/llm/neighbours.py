"""Approximate nearest neighbours by collision-counting hashing.

Each of ``PROJECTIONS`` hash functions is one random projection. A shard of vectors keeps one sorted array
per projection. A query opens a window around its own projection in each array; at radius R the window
reaches ``WIDTH`` x R to both sides (virtual rehashing: the windows only ever grow, nothing is hashed anew).
A vector within R of the query lies in a window with a known probability, so one that has been seen in
``COLLISIONS`` of the arrays is verified by its exact distance. R grows by ``GROWTH`` until the k-th best
verified distance is at most R: then every nearer vector has been verified but for the small chance that
the threshold leaves. No cap cuts windows, candidates or results.

Every vector belongs to the cell of its nearest centre; there are at most ``CELLS`` centres, fitted to a
sample of ``DRAWN`` vectors for each, and they decide only where a vector lies, not what is found. Cells of more than
``SHARD`` rows are several shards. A query searches its own cell first. Its k-th best distance there is the
radius it needs anywhere else, so it opens its windows once, at that radius, and only in cells whose ball
(centre, distance of the farthest member) comes within it; by the triangle inequality no other holds a nearer
vector. Vectors in groups are thus compared with their surroundings. Vectors without any structure in
many dimensions are all about equally far apart, so that no ball can be left out and work grows with queries
times vectors; what is saved there is the growing of windows.

Queries and vectors are rows that meet in one shuffle, a task for each shard and block of about ``QUERY_BLOCK``
queries; the driver holds centres and sizes of cells.

Defined cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components, and rows without id, take no part; rows of one id are never each other's neighbours, and the
first of their vectors is the query; ties go to the smaller id; with fewer than k candidates all are returned;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanternlog.llm.tables import stored, tidy

PROJECTIONS, WIDTH, COLLISIONS, GROWTH = 32, 1.0, 16, 1.3
SHARD, QUERY_BLOCK = 8192, 4096
CELLS, DRAWN, REFINED = 1024, 8, 4
TASKS = 1 << 15
_SCHEMA = "query_id bigint, vec_id bigint, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Shard:
    """Vectors with their projections, sorted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        points = self.vectors @ self.axes
        self.order = np.ascontiguousarray(np.argsort(points, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(points.T), self.order, 1)
        # projections of equal vectors may differ in their last bits
        self.blur = float(np.abs(self.sorted[:, [0, -1]]).max()) * 1e-12

    def search(self, own: int, query: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ids and distances of the k nearest, of those at most ``limit`` away."""
        n, centre = len(self.ids), query @ self.axes
        lo = np.array([np.searchsorted(points, c) for points, c in zip(self.sorted, centre, strict=True)])
        hi, every = lo.copy(), np.arange(PROJECTIONS)

        def gap(more: int) -> float:
            """How far windows have to reach for so many more vectors on one side."""
            below = np.abs(self.sorted[every, np.maximum(lo - 1 - more, 0)] - centre)
            above = np.abs(self.sorted[every, np.minimum(hi + more, n - 1)] - centre)
            return float(np.median(np.minimum(below, above))) / WIDTH

        # the first radius: the one known, or what reaches as many neighbours as are asked for
        radius = limit if np.isfinite(limit) else gap(min(k, n - 1))
        seen = np.zeros(n, np.int64)
        done = self.ids == own
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            reach = WIDTH * radius + self.blur
            if np.isfinite(reach) and np.isfinite(centre).all():
                a = [np.searchsorted(points, c - reach, "left") for points, c in zip(self.sorted, centre, strict=True)]
                b = [np.searchsorted(points, c + reach, "right") for points, c in zip(self.sorted, centre, strict=True)]
                a, b = np.minimum(a, lo), np.maximum(b, hi)
            else:
                a, b = np.zeros_like(lo), np.full_like(hi, n)
            fresh = [order[x:y] for order, x, y in zip(self.order, a, lo, strict=True)]
            fresh += [order[x:y] for order, x, y in zip(self.order, hi, b, strict=True)]
            grown = bool((a < lo).any() or (b > hi).any())
            lo, hi = a, b
            whole = not lo.any() and bool((hi == n).all())
            if grown:
                seen += np.bincount(np.concatenate(fresh), minlength=n)
            found = np.flatnonzero(~done & ((seen >= COLLISIONS) | whole))
            if len(found):
                done[found] = True
                away = np.sqrt(((self.vectors[found] - query) ** 2).sum(1))
                near = ~(away > limit)
                ids, scores = np.append(ids, self.ids[found[near]]), np.append(scores, away[near])
                best = np.lexsort((ids, scores))[:k]
                ids, scores = ids[best], scores[best]
            if whole or radius >= limit or (len(ids) == k and scores[-1] <= radius):
                return ids, scores
            radius = max(radius * GROWTH, gap(0))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vec (double components) of the vectors that take part."""
    vec = F.col(column).cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    most = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("vec") == (most[0]["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centres, good to about 1e-7 of the largest norm."""
    squares = (rows**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (rows @ centres.T)
    return np.sqrt(np.maximum(squares, 0))


def _centres(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of cells: rows of the sample that differ, moved to the means of what is nearest to them."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(REFINED):
        own = np.concatenate([_apart(sample[i : i + 1024], centres).argmin(1) for i in range(0, len(sample), 1024)])
        for c in np.unique(own):
            mean = sample[own == c].mean(0)
            if np.isfinite(mean).all():
                centres[c] = mean
    return centres


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, vec, cell and the distance ``away`` to its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    vectors = _matrix(part.column(1))
                    cell = _apart(vectors, middle).argmin(1)
                    away = np.sqrt(((vectors - middle[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int64)), pa.array(away)], names=["vec_id", "vec", "cell", "away"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id bigint, vec array<double>, cell bigint, away double")


def within_reach(vectors: np.ndarray, limit: np.ndarray, own: np.ndarray, centres: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which queries (rows) have to look into which cells, beside their own, to find all that is at most ``limit`` away."""
    apart = _apart(vectors, centres)
    norms = np.sqrt((vectors**2).sum(1))[:, None] + np.sqrt((centres**2).sum(1))
    # what is not a number or not finite leaves nothing out
    out = apart - farthest - limit[:, None] > 1e-6 * norms
    out |= farthest < 0  # empty cells
    out[np.arange(len(own)), own] = True
    return np.nonzero(~out)


def _searched(queries: DataFrame, vectors: DataFrame, sizes: dict[int, int], k: int, seed: int) -> DataFrame:
    """The k best of every (cell, query_id, vec, limit) in its cell of ``vectors``."""
    spark = queries.sparkSession
    asked = queries.groupBy("cell").count().collect()  # a row for each cell
    rows, tasks = [], 0
    for r in asked:
        shards, blocks = -(-sizes.get(r["cell"], 0) // SHARD), -(-r["count"] // QUERY_BLOCK)
        rows.append((r["cell"], shards, blocks, tasks))
        tasks += shards * blocks
    if not tasks:
        return spark.createDataFrame([], _SCHEMA)
    layout = stored(spark.createDataFrame(rows, "cell bigint, shards bigint, blocks bigint, first bigint").where("shards > 0").coalesce(1), "layout")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    place = (F.col("first") + F.col("shard") * F.col("blocks") + F.col("block")).alias("place")
    one = queries.join(layout, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("shard", upto("shards"))
    # rows of one id are dealt by their vectors as well
    two = vectors.join(layout, "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), "shards")).withColumn("block", upto("blocks"))
    met = one.select(place, F.lit(0).alias("side"), F.col("query_id").alias("id"), "vec", "limit").unionByName(
        two.select(place, F.lit(1).alias("side"), F.col("vec_id").alias("id"), "vec", F.lit(0.0).alias("limit"))
    )
    met = met.repartitionById(min(tasks, TASKS), F.pmod("place", F.lit(min(tasks, TASKS))).cast("int")).sortWithinPartitions("place", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, 0
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def found() -> Iterator[pa.RecordBatch]:
            shard = Shard(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), seed)
            for ids, vecs, limits in asked:
                got = [shard.search(q, v, k, r) for q, v, r in zip(ids.tolist(), vecs, limits.tolist(), strict=True)]
                n = [len(i) for i, _ in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), *(pa.array(np.concatenate([g[c] for g in got])) for c in (0, 1))], schema=_FOUND)

        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                places, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(sides) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                    part = batch.slice(a, b - a)
                    if places[a] != here:
                        if parts:
                            yield from found()
                        here, held, asked, parts = places[a], 0, [], []
                    ids, vecs = part.column(2).to_numpy(), _matrix(part.column(3))
                    if not sides[a]:
                        asked.append((ids, vecs, part.column(4).to_numpy()))
                        continue
                    parts.append((ids, vecs))
                    held += len(ids)
                    if held >= 2 * SHARD:
                        yield from found()
                        held, parts = 0, []
            if parts:
                yield from found()

    return met.mapInArrow(run, _SCHEMA)


@tidy
def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each row of ``queries`` (see ``usable``)."""
    spark = vectors.sparkSession
    cells = min(CELLS, -(-vectors.count() // SHARD))
    if not cells:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    drawn = vectors.select(F.xxhash64("vec_id", "vec").alias("h"), "vec_id", "vec").orderBy("h", "vec_id").limit(cells * DRAWN).toArrow()
    with np.errstate(all="ignore"):
        centres = _centres(_matrix(drawn.column("vec").combine_chunks()), cells, seed)
    members = stored(_placed(vectors, centres), "cells")
    facts = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("farthest")).collect()  # a row for each cell
    sizes = {r["cell"]: r["n"] for r in facts}
    farthest = np.full(len(centres), -1.0)
    for r in facts:
        farthest[r["cell"]] = r["farthest"]
    asked = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = stored(_placed(asked, centres).select("cell", F.col("vec_id").alias("query_id"), "vec", F.lit(float("inf")).alias("limit")), "queries")
    near = stored(_searched(asked, members, sizes, k, seed), "near")

    # the k-th best so far is how far a query still has to look
    best = F.slice(F.array_sort(F.collect_list("score")), k, 1)
    bound = _first(near, k).groupBy("query_id").agg(best.alias("best")).select("query_id", F.get("best", F.lit(0)).alias("bound"))
    known = asked.drop("limit").join(bound, "query_id", "left").select("query_id", "vec", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("limit"))
    shared = spark.sparkContext.broadcast((centres, farthest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    row, cell = within_reach(_matrix(part.column(1)), part.column(3).to_numpy(), part.column(2).to_numpy(), *shared.value)
                    for j in range(0, len(row), 4096):
                        taken = pa.array(row[j : j + 4096])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell[j : j + 4096].astype(np.int64)), *(part.column(c).take(taken) for c in (0, 1, 3))], names=["cell", "query_id", "vec", "limit"]
                        )

    routed = stored(known.mapInArrow(run, "cell bigint, query_id bigint, vec array<double>, limit double"), "routes")
    far = _searched(routed, members, sizes, k, seed)
    return _first(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their ranks."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def report(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all rows."""
    vectors = usable(embeddings)
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
