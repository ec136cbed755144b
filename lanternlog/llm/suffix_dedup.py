"""Exact substring deduplication: bytes covered by a string of ``SPAN`` bytes that also starts elsewhere go.

Only places that can repeat reach a suffix array. In every window of ``SPAN`` bytes the ``GRAM``-byte string
of smallest hash is the window's anchor; equal windows have equal anchors at equal offsets. So

1. anchors that occur once leave (their windows are unique); an anchor's windows form one segment of text;
2. segments that are equal byte for byte repeat wholly; one of each stands for all;
3. the different segments of one anchor meet in a task. They are cut into blocks on a grid that starts
   at the anchor, and the suffixes of the sequence of blocks are sorted by ``suffix_array``. Windows are
   placed between the block suffixes they lead up to, which brings equal windows together;
4. an anchor with more than ``CROWD`` different segments is split before: the offsets of its windows into
   cells, and each cell by the text that all its windows share, halving the cells until no group is
   crowded. A cell of one offset holds equal windows only.

Texts that occur several times repeat wholly; one of each takes part in the steps above. Which texts are equal
is told by their SHA-256, of which 16 bytes name a text throughout. Long texts are worked on in pieces whose
windows join up. What needs no text (copies, and texts that nothing was found in) is settled on narrow rows; text
moves only for the places that repeat and for texts that lose a part.

``suffix_array`` is the linear grouping construction: suffixes are grouped by Lyndon prefix, the groups
taken in descending order, each moving the previous smaller suffixes of its members to groups of their own;
afterwards one pass places every suffix at the front of its group, following the same pointers.

Defined cases: a null text is empty; texts shorter than ``SPAN`` bytes stay whole; repeated rows are
equal texts and go wholly from ``SPAN`` bytes on; a null id is as good as any.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanternlog.llm import bytes as B
from lanternlog.llm.bloom import bits_of, within
from lanternlog.llm.tables import stored, tidy

SPAN, GRAM = 200, 32
OFFSETS = SPAN - GRAM + 1
BLOCK, CROWD = 32, 4096
_SLICE = 1 << 20  # bytes of text whose windows a task holds at once
_U = np.uint64


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes in order; the last symbol must be smaller than all others."""
    n = len(text)
    if not n:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    low, high = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    high[-1] = -1
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    smaller = [-1] * n  # the last suffix before it that lies in a lower group
    done = bytearray(n)
    ranked: list[int] = []  # groups, the highest first
    g = len(members) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        ranked.append(g)
        members[g] = own
        pointed: dict[int, int] = {}
        for i in own:
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        # what is pointed at moves to a new group right above its old one, those pointed at more often higher
        leaving: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            leaving.setdefault((-times, group[p]), []).append(p)
        for (_, old), some in sorted(leaving.items()):
            new = len(members)
            members.append(some)
            for p in some:
                group[p] = new
            low.append(old)
            high.append(high[old])
            low[high[old]] = new
            high[old] = new
        g = low[g]
    free = [0] * len(members)
    place = 0
    for g in reversed(ranked):
        free[g] = place
        place += len(members[g])
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def anchors(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start of the first window, number of windows, offset of the anchor in the first, anchor hash, segment hash)."""
    none = np.zeros(0, np.int64)
    if len(buf) < SPAN:
        return none, none, none, none, none.astype(_U), none.astype(_U)
    h = B.prefix_hashes(buf)
    start = np.arange(len(buf) - GRAM + 1)
    gram = B.range_hashes(h, start, start + GRAM)
    least = (gram & _U(0xFFFFFFFF00000000)) | start.astype(_U)  # the first of the smallest in each window
    width = 1
    while 2 * width <= OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(gram) - OFFSETS + 1
    least = np.minimum(least[:n], least[OFFSETS - width : OFFSETS - width + n])
    owner = (least & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(at, np.arange(n), "right") - 1
    window = np.flatnonzero(np.arange(n) + SPAN <= at[row + 1])
    if not len(window):
        return none, none, none, none, none.astype(_U), none.astype(_U)
    owner, row = owner[window], row[window]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(row) != 0))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    begin, anchor = window[head], owner[head]
    whole = B.range_hashes(h, begin, begin + count + SPAN - 1)
    segment = B.mix(whole ^ B.mix((anchor - begin).astype(_U)))
    return row[head], begin - at[row[head]], count, anchor - begin, gram[anchor], segment


def repeated(segments: list[bytes], starts: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """For each segment which of its windows also occur in another segment of its group.

    starts: where a segment begins, relative to its group's anchor.
    """
    size = np.array([len(s) for s in segments])
    buf = np.frombuffer(b"".join(segments), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    # blocks on the grid of the anchor; the last one of a segment may be short
    skip = -starts % BLOCK
    blocks = np.maximum(-(-(size - skip) // BLOCK), 0)
    owner = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    padded = np.append(buf, np.zeros(BLOCK, np.uint8))
    where = at[owner] + skip[owner] + number * BLOCK
    cells = padded[where[:, None] + np.arange(BLOCK)]
    cells[np.arange(BLOCK) >= (at[owner + 1] - where)[:, None]] = 0
    words = np.ascontiguousarray(cells).view(">u8").astype(_U)
    order = np.lexsort(words.T[::-1])
    differ = np.append(False, (words[order][1:] != words[order][:-1]).any(1))
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(differ) + 2
    begin = np.concatenate([[0], np.cumsum(blocks + 1)])  # a 1 after each segment, a 0 at the end
    text = np.ones(begin[-1] + 1, np.int64)
    text[np.arange(len(owner)) + owner] = symbol
    text[-1] = 0
    rank = np.empty(len(text), np.int64)
    rank[suffix_array(text.tolist())] = np.arange(len(text))
    # windows: by group, offset and the bytes before the first block, then by the suffix from there on
    windows = size - SPAN + 1
    own = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    ahead = (skip[own] - place) % BLOCK
    h = B.prefix_hashes(buf)
    a = at[own] + place
    lead = B.range_hashes(h, a, a + ahead)
    after = rank[begin[own] + (place + ahead - skip[own]) // BLOCK]
    offset = starts[own] + place
    order = np.lexsort((after, lead, offset, groups[own]))
    whole = B.range_hashes(h, a, a + SPAN)[order]
    same = (whole[1:] == whole[:-1]) & (offset[order][1:] == offset[order][:-1]) & (groups[own][order][1:] == groups[own][order][:-1])
    found = np.zeros(len(own), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.split(found, np.cumsum(windows)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_PLACE = "key binary, start bigint, n int, ahead int, anchor bigint, segment bigint"


def _pieces(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, one past the last, first byte, one past the last) of what is searched for anchors at once.

    A text longer than a slice comes in pieces, each with the bytes that its last window needs; a run of windows
    that a cut divides is two segments of one anchor, at different offsets from it.
    """
    for i, j in B.slices(at, _SLICE):
        if at[j] - at[i] <= _SLICE:
            yield i, j, at[i], at[j]
        else:
            for a in range(at[i], at[j] - SPAN + 1, _SLICE):
                yield i, j, a, min(a + _SLICE + SPAN - 1, at[j])


def _anchored(texts: DataFrame, one: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """Anchors of the texts (key, text, mark): of those whose mark is null or in the filter ``one``.

    ``wanted`` is a filter of anchors. Both are looked up where the anchors are made: rows that they refuse
    never leave the task's Python worker, and no second worker holds batches beside it.
    """
    shared = texts.sparkSession.sparkContext.broadcast((one, wanted))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, wanted = shared.value
        for batch in batches:
            mark = batch.column(2)
            kept = np.array(mark.is_null()) | within(one, mark.fill_null(0).to_numpy())
            batch = batch.filter(pa.array(kept))
            buf, at = B.utf8(batch.column(1))
            for i, j, a, b in _pieces(buf, at):
                row, *rest = anchors(buf[a:b], np.clip(at[i : j + 1], a, b) - a)
                if wanted is not None:
                    some = within(wanted, rest[3].view(np.int64))
                    row, rest = row[some], [x[some] for x in rest]
                start, n, ahead, anchor, segment = rest
                start = start + (a - at[i] if j == i + 1 else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + i)), pa.array(start), pa.array(n, pa.int32()), pa.array(ahead, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))],
                    names=["key", "start", "n", "ahead", "anchor", "segment"],
                )

    return texts.select("key", "text", "mark").mapInArrow(run, _PLACE)


def _texts_of(texts: DataFrame, keys: DataFrame, one: np.ndarray) -> DataFrame:
    """key and text of the texts (key, text, mark) that take part and whose key is in ``keys``, and of a few others."""
    shared = texts.sparkSession.sparkContext.broadcast((one, bits_of(keys.select(F.xxhash64("key").alias("h")), "h")))

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, wanted = shared.value
        for batch in batches:
            mark = batch.column(2)
            kept = np.array(mark.is_null()) | within(one, mark.fill_null(0).to_numpy())
            kept &= within(wanted, batch.column(3).to_numpy())
            yield batch.select(["key", "text"]).filter(pa.array(kept))

    return texts.select("key", "text", "mark", F.xxhash64("key").alias("h")).mapInArrow(run, "key binary, text string")


def _compared(segments: DataFrame) -> DataFrame:
    """anchor, segment, start and stop (offsets from the anchor) of repeated windows, groups side by side in tasks."""
    dealt = segments.repartition("group").sortWithinPartitions("group")

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judged() -> pa.RecordBatch:
            found = repeated([r[4] for r in held], np.array([r[3] for r in held]), np.unique([r[0] for r in held], return_inverse=True)[1])
            rows = [(r[1], r[2], r[3] + a, r[3] + b) for r, f in zip(held, found, strict=True) for a, b in _runs(f)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["anchor", "segment", "start", "stop"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 1 << 20 and r[0] != held[-1][0]:
                    yield judged()
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield judged()

    return dealt.select("group", "anchor", "segment", "first", "bytes").mapInArrow(run, "anchor bigint, segment bigint, start int, stop int")


def _uncrowded(segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Segments in groups of at most ``CROWD``, and repeats already found while splitting larger groups."""
    size = segments.groupBy("group").agg(F.count("*").alias("size"))
    fine: list[DataFrame] = []
    known: list[DataFrame] = []
    cell = OFFSETS
    while True:
        sized = stored(size, "group-sizes")
        fine.append(segments.join(sized.where(F.col("size") <= CROWD).select("group"), "group", "left_semi"))
        crowded = sized.where(F.col("size") > CROWD).select("group")
        if not crowded.limit(1).count():
            break
        cell = -(-cell // 2)
        shift = lambda c: F.expr(f"({c} + {OFFSETS - 1}) div {cell}")
        last = F.col("first") + F.length("bytes") - SPAN
        cut = segments.join(crowded, "group", "left_semi").withColumn("last", last)
        cut = cut.withColumn("cell", F.explode(F.sequence(shift("first"), shift("last"))))
        at = (F.col("cell") * cell - (OFFSETS - 1)).cast("int")
        a, b = F.greatest("first", at).cast("int"), F.least("last", at + (cell - 1)).cast("int")
        common = F.substring("bytes", at + (cell - 1) - F.col("first") + 1, F.lit(SPAN - cell + 1))
        part = F.substring("bytes", a - F.col("first") + 1, b - a + SPAN)
        cut = cut.select(
            F.xxhash64("group", "cell", common).alias("group"), "anchor", "segment", a.alias("first"), part.alias("bytes"), F.xxhash64(part, a).alias("_own")
        )
        cut = stored(cut, "cells")
        size = cut.groupBy("group").agg(F.count("*").alias("size"), (F.min("_own") != F.max("_own")).alias("mixed")).where("size > 1")
        alike = cut.join(size.where("not mixed").select("group"), "group", "left_semi")
        known.append(alike.select("anchor", "segment", F.col("first").alias("start"), (F.col("first") + F.length("bytes") - SPAN + 1).alias("stop")))
        size = size.where("mixed").select("group", "size")
        segments = cut.drop("_own")
    out = fine[0]
    for part in fine[1:]:
        out = out.unionByName(part)
    return out, known


def _ranges(texts: DataFrame, one: np.ndarray) -> DataFrame:
    """key and the byte ranges to remove, for texts (key, text, mark) that occur once or stand for others.

    ``one`` is the filter of the marks that take part; a null mark does.
    """
    twice = _anchored(texts, one).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    twice = stored(twice, "anchors")
    places = _anchored(texts, one, bits_of(twice, "anchor"))
    places = stored(places.join(twice, "anchor", "left_semi"), "places")
    # one of each segment stands for all that are equal to it
    each = places.groupBy("anchor", "segment").agg(
        F.count("*").alias("times"), F.min(F.struct("key", "start", "n", "ahead")).alias("at")
    )
    each = stored(each, "segments")
    many = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = each.join(many, "anchor", "left_semi").select("at.*", "anchor", "segment")
    wanted = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("start", "n", "ahead", "anchor", "segment")).alias("of")), "wanted")
    source = _texts_of(texts, wanted, one).join(wanted, "key")
    cut = source.select(F.col("text").cast("binary").alias("text"), F.explode("of").alias("s")).select(
        F.col("s.anchor").alias("group"),
        "s.anchor",
        "s.segment",
        (-F.col("s.ahead")).alias("first"),
        F.substring("text", (F.col("s.start") + 1).cast("int"), F.col("s.n") + (SPAN - 1)).alias("bytes"),
    )
    groups, known = _uncrowded(stored(cut, "cut"))
    found = _compared(groups)
    for part in known:
        found = found.unionByName(part)
    found = stored(found, "repeats")
    whole = places.join(each.where("times > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    whole = whole.select("key", F.col("start").alias("a"), (F.col("start") + F.col("n") + (SPAN - 1)).alias("b"))
    partly = places.join(found.withColumnRenamed("start", "from"), ["anchor", "segment"])
    partly = partly.select(
        "key", (F.col("start") + F.col("ahead") + F.col("from")).alias("a"), (F.col("start") + F.col("ahead") + F.col("stop") + (SPAN - 1)).alias("b")
    )
    return whole.unionByName(partly).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


#: Parts that the rows of one text are dealt into when they learn that they are copies.
_SALT = 32


def _cut(text: bytes, ranges: list[dict]) -> tuple[int, int, str]:
    """Bytes removed, maximal runs removed, and the SHA-256 of what is left; ranges are in order and may overlap."""
    rest, gone, spans, upto = sha256(), 0, 0, 0
    stop = -1
    for r in ranges:
        if r["a"] > stop:
            rest.update(memoryview(text)[upto : r["a"]])
            spans += 1
            stop = r["a"]
        if r["b"] > stop:
            gone += r["b"] - stop
            stop = r["b"]
        upto = stop
    rest.update(memoryview(text)[upto:])
    return gone, spans, rest.hexdigest()


@tidy
def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    key = F.substring(F.unhex(digest), 1, 16)
    mark = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    size = F.octet_length(text).cast("bigint")
    narrow = stored(docs.select("doc_id", key.alias("key"), digest.alias("digest"), size.alias("n_bytes")), "texts")
    long = narrow.where(F.col("n_bytes") >= SPAN)
    classes = long.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    classes = stored(classes, "classes")
    # one text of each kind takes part; a few more that the filter lets through do no harm
    one = bits_of(classes.where("one is not null").select(F.xxhash64("one").alias("mark")), "mark")
    texts = docs.where(size >= SPAN).select(key.alias("key"), text.alias("text"), mark.alias("mark"))
    copied = classes.where("copies > 1").select("key")
    # copies go whole, whatever was found in the one that took part
    ranges = stored(_ranges(texts, one).join(copied, "key", "left_anti"), "ranges")
    cut = _texts_of(texts, ranges, one).join(ranges, "key")

    @B.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cut(t.as_py().encode(), r.as_py()) for t, r in zip(batch.column(1), batch.column(2), strict=True)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                names=["key", "n_removed", "n_spans", "kept_sha256"],
            )

    touched = cut.select("key", "text", "ranges").mapInArrow(run, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    # every key of a text that is touched is one row; the keys of copies, dealt out, are marked first
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(_SALT)).cast("int")
    dealt = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))).withColumn("copy", F.lit(True))
    marked = long.withColumn("salt", salt).join(dealt, ["key", "salt"], "left")
    zero = F.lit(0).cast("bigint")
    copies = marked.where("copy").select(
        "doc_id",
        "n_bytes",
        F.col("n_bytes").alias("n_removed"),
        F.lit(1).cast("bigint").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"),
    )
    single = marked.where("copy is null").join(stored(touched, "touched"), "key", "left")
    single = single.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
    )
    short = narrow.where(F.col("n_bytes") < SPAN).select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("digest").alias("kept_sha256")
    )
    return copies.unionByName(single).unionByName(short)
