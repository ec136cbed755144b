"""Exact Jaccard join of word shingles as a join in a metric space.

Documents with one set of shingles are one point. The distance 1 - Jaccard is a metric, so with the
distance of a pivot to two points known, |d(x, p) - d(y, p)| <= d(x, y): points whose distances to a pivot
differ by more than the radius are not linked.

Unrelated texts are all at distance 1 from each other, so pivots drawn at large would tell nothing and
every window would hold everything. Space is therefore first cut into regions that a link cannot avoid:
two sets with Jaccard similarity s or more share a shingle among the n - ceil(s n) + 1 rarest of each (an
order by frequency, any order is exact). The region of a shingle is the sets that hold it among those.
Regions of one set vanish. In regions of at most ``SMALL`` sets the pairs that share enough of their rarest
shingles to allow a link are compared directly. The larger regions are named after their most central set,
the pivot, and regions of one pivot become one. In each

1. every set gets its exact distance to the pivot. The sets within the radius are the pivot's cell: they
   are linked to it and settled among each other;
2. the sets outside are compared with each other and with the boundary sets inside that one outside can
   reach. Distances are cut into bands of one radius; only adjacent bands meet (the triangle-inequality
   window), in blocks of bounded chunks, so a large region is many tasks;
3. a region with more than ``WIDE`` sets outside is divided first: ``PIVOTS`` of them become new pivots,
   every set goes to its nearest one (Voronoi regions) and is replicated to those whose window it lies in,
   and each region returns to 1. A region that its pivots did not halve (its sets are all about equally far
   from each other, which no metric join can prune) is compared as it is, in blocks.

Links between different sets come out as pairs that connect all that is connected, with their exact
similarity; components are taken over them. Frequencies only order the shingles: what tasks count twice
or more is summed and the ``FREQUENT`` most frequent are broadcast, and so are those that turn out to crowd regions.

Defined cases: a null or empty text has an empty set, is linked with nothing and is its own component; a
null id takes no part and has a null component; repeated rows are copies; equal sets are linked whatever
their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.llm import bytes as B
from lanternlog.llm.bloom import bits_of, filter_of, test_of, within
from lanternlog.llm.components import components
from lanternlog.llm.tables import done, stored, tidy

WORDS, PERCENT = 4, 85
FREQUENT, OFTEN = 1 << 18, 16
LOOKED_AT = 2 << 20  # shingles that a task looks at together for frequent ones
SMALL = 48
PIVOTS, WIDE = 16, 1 << 14
CHUNK = 1 << 17  # shingles that the sets of one chunk of a block hold, about
_U = np.uint64
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63)]


def shingles(buf: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (a shorter text: of its whole sequence), and where each row's begin."""
    hashes, first = B.word_hashes(buf, at, B.GRAPHIC)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    place = first[row] + np.arange(len(row)) - begin[row]
    length = np.minimum(n, words)[row]
    out = length.astype(_U)
    padded = np.concatenate([hashes, np.zeros(words, _U)])
    for k in range(words):
        out = B.mix(out * _FACTORS[4] + np.where(k < length, padded[place + k], _U(k)) * _FACTORS[k % 4])
    return out, begin


def _sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice the distinct shingles of its rows, each row's in order, and where they begin."""
    buf, at = B.utf8(column)
    for i, j in B.slices(at):
        flat, begin = shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], words)
        flat = flat.view(np.int64)  # the order of bigints, here and in Spark
        own = [np.unique(flat[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        yield np.concatenate(own) if own else flat, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


#: Shingles in order and how often they were seen.
Often = tuple[np.ndarray, np.ndarray]


def frequent(docs: DataFrame, words: int) -> Often:
    """Shingles that tasks saw often, in order, and how often."""

    def seen_often(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        some = n > 1
        return pa.RecordBatch.from_arrays([pa.array(values[some]), pa.array(n[some].astype(np.int64))], names=["shingle", "n"])

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for flat, _ in _sets(batch.column(0), words):
                parts.append(flat)
                held += len(flat)
                if held >= LOOKED_AT:
                    yield seen_often(parts)
                    parts, held = [], 0
        if parts:
            yield seen_often(parts)

    seen = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    keys = rows.column("shingle").to_numpy()
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


def signatures(docs: DataFrame, words: int, percent: int, often: Often, bits: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (set size), two halves of the set's identity, its rarest shingles and how many are not frequent.

    ``last`` places the last of the rarest shingles in the order of all. With ``bits``, only of the ids that this
    filter lets through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*often, bits))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times, bits = shared.value
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(within(bits, batch.column(2).to_numpy())))
            sizes, one, two, rare, alone, last = [], [], [], [], [], []
            for flat, begin in _sets(batch.column(1), words):
                k = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
                n = np.where(often[k] == flat, times[k], 0) if len(often) else np.zeros(len(flat), np.int64)
                a, b = B.mix(flat.view(_U)), B.mix(flat.view(_U) ^ _FACTORS[1])
                for i, j in zip(begin[:-1], begin[1:], strict=True):
                    size = int(j - i)
                    sizes.append(size)
                    one.append(int(a[i:j].sum(dtype=_U).view(np.int64)))
                    two.append(int(b[i:j].sum(dtype=_U).view(np.int64)))
                    alone.append(int((n[i:j] == 0).sum()))
                    kept = size - -(-percent * size // 100) + 1 if size else 0
                    order = np.argsort(n[i:j], kind="stable")[:kept]
                    rare.append(flat[i:j][order])
                    last.append({"n": int(n[i:j][order[-1]]), "shingle": int(rare[-1][-1])} if size else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    B.lists(np.concatenate(rare) if rare else [], np.concatenate([[0], np.cumsum([len(x) for x in rare])]), pa.int64()),
                    pa.array(alone, pa.int64()),
                    pa.array(last, pa.struct([("n", pa.int64()), ("shingle", pa.int64())])),
                ],
                names=["doc_id", "n", "one", "two", "rare", "alone", "last"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if bits is not None:
        rows = rows.withColumn("h", F.xxhash64("doc_id"))
    return rows.mapInArrow(
        run, "doc_id bigint, n bigint, one bigint, two bigint, rare array<bigint>, alone bigint, last struct<n:bigint,shingle:bigint>"
    )


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and all shingles of the wanted documents, and of a few others that the filter lets through.

    The texts stay where they are: a join would shuffle every one of them.
    """

    shared = docs.sparkSession.sparkContext.broadcast(bits_of(wanted.select(F.xxhash64("id").alias("h")), "h"))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(within(bits, batch.column(2).to_numpy())))
            done = 0
            for flat, begin in _sets(batch.column(1), words):
                n = len(begin) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), B.lists(flat, begin, pa.int64())], names=["id", "shingles"])
                done += n

    # looked up where the shingles are made, by the one Python worker of a task
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null")
    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id bigint, shingles array<bigint>")


def _may_link(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with their exact distance and whether they link."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    out = pairs.join(left, "a").join(right, "b").select("a", "b", common.cast("bigint").alias("c"), (F.size("of_a") + F.size("of_b")).cast("bigint").alias("s"))
    union = F.col("s") - F.col("c")
    return out.select("a", "b", (F.col("c") * 100 >= union * percent).alias("linked"), (1 - F.col("c") / union).alias("d"))


def _direct(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of small regions that may link, by how many of their rarest shingles they share.

    Of two sets take the one whose rarest shingles end first in the order. What it holds of them and
    the other does not is not in the other at all, and a link leaves room for few such shingles.
    Shingles of crowded regions are not paired here; a pair may share all that it has of those.
    """
    side = members.select("shingle", "id", "n")
    other = side.select("shingle", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = side.join(other, "shingle").where((F.col("id") < F.col("b")) & _may_link("n", "m", percent))
    pairs = pairs.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"))
    for name in ("a", "b"):
        pairs = pairs.join(points.select(F.col("id").alias(name), F.struct("n", "crowded", "last", "kept").alias(f"of_{name}")), name)
    first = F.when(F.col("of_a.last") <= F.col("of_b.last"), F.col("of_a")).otherwise(F.col("of_b"))
    both = F.col("of_a.n") + F.col("of_b.n")
    shared = F.col("shared") + F.least("of_a.crowded", "of_b.crowded")
    needed = F.ceil(both * percent / F.lit(100 + percent) - 1e-9)  # common shingles of a link
    return pairs.where(first["kept"] - shared <= first["n"] - needed).select("a", "b")


def _points(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n, rare, alone, last of one row of each class."""
    rows = signed.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.select(F.col("doc_id").alias("id"), "n", "rare", "alone", "last").where("n > 0")


def _sizes(points: DataFrame) -> DataFrame:
    """How many points have a shingle among their rarest; only of those that two have."""
    members = points.select(F.explode("rare").alias("shingle"))
    return stored(members.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1"), "sizes")


def _holding(points: DataFrame, shingles: np.ndarray) -> DataFrame:
    """id of the points that have one of the shingles (in order) among their rarest."""
    shared = points.sparkSession.sparkContext.broadcast(shingles)

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            k = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            seen = np.concatenate([[0], np.cumsum(some[k] == flat)])
            at = at - at[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(seen[at[1:]] > seen[at[:-1]]))], names=["id"])

    return points.select("id", "rare").mapInArrow(run, "id bigint")


def _reordered(docs: DataFrame, points: DataFrame, classes: DataFrame, often: Often, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Points and sizes of their regions, once the shingles of crowded regions count as frequent too.

    Tasks see little of a large input: what is rare in each and frequent in all would crowd regions with sets that
    have nothing else in common. Such shingles now come after all that are rare. Points without one among their rarest
    keep those: taking others out of the rare ones changes nothing before them. The others are read again.
    """
    sizes = _sizes(points)
    found = sizes.where(F.col("size") > SMALL).orderBy(F.desc("size"), "shingle").limit(FREQUENT).toArrow()
    keys, times = found.column("shingle").to_numpy(), found.column("size").to_numpy()
    new = ~np.isin(keys, often[0])
    if not new.any():
        return points, sizes
    touched = stored(_holding(points, np.sort(keys[new])), "touched")
    bits = bits_of(touched.select(F.xxhash64("id").alias("h")), "h")
    keys, times = np.concatenate([often[0], keys[new]]), np.concatenate([often[1], times[new]])
    order = np.argsort(keys)
    again = _points(signatures(docs, words, percent, (keys[order], times[order]), bits), classes)
    same = points.where(~test_of(points.sparkSession, bits)(F.xxhash64("id")))
    changed = stored(same.unionByName(again), "points")
    done(points, sizes, touched)
    return changed, _sizes(changed)


def links(docs: DataFrame, points: DataFrame, sizes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b: linked pairs of ``points`` (id, n, rare, alone, last) that connect all that is connected.

    Written tables are removed as soon as they are read for the last time, ``points`` and ``sizes`` among them.
    """
    members = points.select("id", "n", "alone", F.explode("rare").alias("shingle"))
    members = stored(members.join(sizes, "shingle"), "regions")
    facts = stored(points.select("id", "n", "last", F.size("rare").alias("kept")), "facts")
    done(points, sizes)
    crowd = members.where(F.col("size") > SMALL)
    in_crowds = crowd.groupBy("id").agg(F.count("*").alias("crowded"))
    known = facts.join(in_crowds, "id", "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    direct = stored(_direct(members.where(F.col("size") <= SMALL), known, percent), "pairs")
    region = stored(_with_pivots(crowd), "crowds")
    done(members, facts)
    wanted = direct.select(F.col("a").alias("id")).union(direct.select("b")).union(region.select("id")).distinct()
    sets = stored(_whole_sets(docs, wanted, words), "sets")
    near = _measured(direct, sets, percent).where("linked").select("a", "b")
    return stored(near.unionByName(_crowded(region, sets, percent)), "found")


def _with_pivots(crowd: DataFrame) -> DataFrame:
    """pivot, id: crowded regions under their most central sets, those with the fewest shingles of their own.

    Regions of one pivot become one region, so the many shingles that one group of near copies shares
    are one region or a few.
    """
    centre = crowd.groupBy("shingle").agg(F.min(F.struct("alone", "id")).alias("p"))
    return crowd.join(centre.select("shingle", F.col("p.id").alias("pivot")), "shingle").select("pivot", "id").distinct()


def _distances(region: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of a region (pivot, id and more) with n, the exact distance d to the pivot, and whether it links."""
    pivots = sets.join(region.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi")
    pivots = stored(pivots.select(F.col("id").alias("pivot"), F.col("shingles").alias("_of")), "pivots")
    common = F.size(F.array_intersect("shingles", "_of"))
    rows = region.join(sets, "id").join(pivots, "pivot")
    rows = rows.withColumn("_c", common.cast("bigint")).withColumn("n", F.size("shingles").cast("bigint"))
    union = F.col("n") + F.size("_of") - F.col("_c")
    rows = rows.withColumn("d", 1 - F.col("_c") / union).withColumn("linked", F.col("_c") * 100 >= union * percent)
    return rows.drop("shingles", "_of", "_c")


def _crowded(region: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs a, b of the regions (pivot, id) that connect all that is connected in them."""
    radius = 1 - percent / 100
    rows = stored(_distances(region.withColumn("room", F.lit(2**62)), sets, percent), "distances")
    found = []
    while True:
        found.append(rows.where("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        # who is left: sets outside the pivot's ball, and those inside that one outside may reach
        outer = rows.where("not linked").groupBy("pivot").agg(F.min("d").alias("nearest"), F.count("*").alias("outers"))
        rest = rows.join(outer, "pivot").where(~F.col("linked") | (F.col("d") >= F.col("nearest") - radius - 1e-9)).drop("nearest")
        size = rest.groupBy("pivot").agg(F.count("*").alias("size"))
        rest = stored(rest.join(size, "pivot"), "outside")
        # a region that its parent's pivots did not halve is compared as it is
        wide = (F.col("outers") > WIDE) & (F.col("size") <= F.col("room"))
        found.append(_blocks(rest.where(~wide).select("pivot", "id", "n", "d", "linked"), sets, percent))
        rest = rest.where(wide)
        if not rest.limit(1).count():
            break
        rows = stored(_divided(rest, sets, percent), "cells")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _divided(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Regions under new pivots, drawn among the sets outside the old pivot's ball.

    A set belongs to its nearest pivot; where y lies within the radius r of x and belongs to p, the triangle
    inequality gives d(x, p) <= d(x, own pivot of x) + 2 r. Sets in that window are replicated.
    """
    radius = 1 - percent / 100
    drawn = rest.where("not linked").select("pivot", "id", F.xxhash64("id").alias("_h"))
    lowest = Window.partitionBy("pivot").orderBy("_h", "id")
    drawn = drawn.withColumn("_k", F.row_number().over(lowest)).where(F.col("_k") <= PIVOTS).select("pivot", F.col("id").alias("new"))
    asked = rest.join(drawn, "pivot").select(F.col("new").alias("pivot"), "id", F.col("pivot").alias("old"), F.ceil(F.col("size") / 2).cast("bigint").alias("room"))
    measured = stored(_distances(asked, sets, percent), "distances")
    nearest = measured.groupBy("old", "id").agg(F.min("d").alias("own"))
    rows = measured.join(nearest, ["old", "id"]).where(F.col("d") <= F.col("own") + 2 * radius + 1e-9)
    # one pivot may be drawn in several regions; they become one
    return rows.groupBy("pivot", "id").agg(*[F.first(c).alias(c) for c in ("n", "d", "linked")], F.max("room").alias("room"))


def _blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the sets outside a pivot's ball and all sets whose distance to the pivot is close to theirs.

    Distances are cut into bands as wide as the radius; a set outside meets its own and the adjacent bands.
    Sets of a band are dealt into chunks by the shingles they hold, and each pair of chunks is one block.
    """
    radius = 1 - percent / 100
    rest = rest.withColumn("band", F.floor(F.col("d") / radius))
    outers = rest.where("not linked").groupBy("pivot", "band").agg(F.ceil(F.sum("n") / CHUNK).alias("left"))
    reach = rest.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sides = reach.groupBy("pivot", "band").agg(F.ceil(F.sum("n") / CHUNK).alias("right"))
    bands = stored(outers.join(sides, ["pivot", "band"]), "bands")
    chunk = lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    one = rest.where("not linked").join(bands, ["pivot", "band"]).select("pivot", "band", chunk("left").alias("x"), every("right").alias("y"), F.lit(0).alias("side"), "id")
    two = reach.join(bands, ["pivot", "band"]).select("pivot", "band", every("left").alias("x"), chunk("right").alias("y"), F.lit(1).alias("side"), "id")
    place = ["pivot", "band", "x", "y"]
    dealt = one.unionByName(two).join(sets, "id").select(F.xxhash64(*place).alias("block"), *place, "side", "id", "shingles")
    dealt = dealt.repartition("block").sortWithinPartitions(*place, "side")

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = None, _Chunk(percent)
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(1, 6)), batch.column(6).to_pylist(), strict=True))
            lists = batch.column(7)
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            a, b = [], []
            for i, (*key, side, name) in enumerate(keys):
                if key != block:
                    block, known = key, _Chunk(percent)
                own = flat[at[i] : at[i + 1]]
                if not side:
                    known.add(name, own)
                else:
                    for other, end in known.linked(name, own):
                        a.append(other)
                        b.append(end)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stored(dealt.mapInArrow(run, "a bigint, b bigint").distinct(), "block-links")


class _Chunk:
    """Sets side by side; tells which of them a further set is linked to, leaving out what is connected already."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple[np.ndarray, np.ndarray] | None = None
        self.joined: list[int] = []

    def add(self, name: int, own: np.ndarray) -> None:
        self.joined.append(len(self.names))
        self.names.append(name)
        self.sets.append(own)

    def _root(self, i: int) -> int:
        while self.joined[i] != i:
            self.joined[i] = i = self.joined[self.joined[i]]
        return i

    def linked(self, name: int, own: np.ndarray) -> list[tuple[int, int]]:
        if not self.sets:
            return []
        if self.index is None:
            self.size = np.array([len(s) for s in self.sets])
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], np.repeat(np.arange(len(self.sets)), self.size)[order]
        keys, owner = self.index
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = hi - lo
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(self.sets))
        out = []
        first = -1
        for i in np.flatnonzero(common * 100 >= (self.size + len(own) - common) * self.percent).tolist():
            if self.names[i] == name:
                continue
            root = self._root(i)
            if first < 0:
                out.append((name, self.names[i]))
                first = root
            elif root != first:
                out.append((name, self.names[i]))
                self.joined[root] = first
        return out


@tidy
def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    often = frequent(docs, words)
    signed = stored(signatures(docs, words, percent, often), "signatures")
    identity = ["one", "two", "n"]
    classes = stored(signed.where("n > 0 and doc_id is not null").groupBy(*identity).agg(F.min("doc_id").alias("id")), "classes")
    points = stored(_points(signed, classes), "points")
    rows = stored(signed.select("doc_id", *identity), "rows")
    done(signed)
    points, sizes = _reordered(docs, points, classes, often, words, percent)
    label = components(links(docs, points, sizes, words, percent))
    own = stored(
        classes.join(label, F.col("id") == F.col("node"), "left").select(*identity, F.coalesce("component", "id").alias("component")),
        "class-components",
    )
    out = rows.join(own, identity, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


@tidy
def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that remain when one of each component stays: the one with the smallest id.

    Rows without id stay; so do rows that repeat an id, which name one document.
    """
    gone = stored(join(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    # only rows that the filter takes for copies are shuffled to be looked up
    maybe = filter_of(gone, "doc_id")(docs["doc_id"])
    looked_up = docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return docs.where(~maybe).unionByName(looked_up)
