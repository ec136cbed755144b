"""How far sources of one language differ in their words, and by which words.

The counts of a language are a matrix: a row for each (language, source) group, a column for each term that
enough documents hold. With add-one smoothing every cell has a probability p (in 10^-9, an integer), and the
divergence of a group from another is the sum over all terms of (p - q)^2 / q, rounded down per term.

The matrix is mostly zero. It is cut into tiles (``ROWS`` groups by about ``WIDTH`` terms), a tile into squares,
and each square becomes a k^2-tree with k = 2: a node has a bit for each quadrant that holds a count, only such
quadrants have nodes below, leaves hold small blocks of counts. Two groups' rows are compared by walking the two
trees together, level by level: where both quadrants are empty the price is the number of their columns times one
term's price, found without going further; leaves where either holds a count are compared cell by cell. Terms that
no row of a tile holds are priced in the same way when the tiles are added up. All arithmetic is on integers.

Work grows with counts that are not zero; a term or a group never gathers in one task (a group's row is dealt out
by terms, a term's column by groups), and counting starts within tasks, so frequent words shuffle as few rows.

Null text, language and source are empty. A row is a document; a repeated row is another document. A group without
terms counts, with probability of add-one alone. A language without kept terms has pairs of value 0 and no term
rows; one with a single source has no pairs. An empty table gives no rows. Other columns are ignored. Texts are
split in pieces; of a text only its distinct terms are held.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.llm.tables import stored, tidy

#: Groups and (about) terms of a tile: what one task compares at once.
ROWS, WIDTH = 128, 2048
#: Side of a leaf of the trees.
LEAF = 8
#: Bytes of a text split at once, and terms counted in a task before they are passed on.
PIECE, HELD = 1 << 20, 200_000
#: Copies of the table of groups that its join is spread over.
SALT = 32
MIN_DOCS, TOP = 3, 200

# A-Z lower-cased; letters and all bytes beyond ASCII kept, anything else ends a term
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms per group, for runs of rows that hold at most about ``most`` terms."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang), len(n)),
                    pa.repeat(pa.scalar(source), len(n)),
                    terms,
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            mine: set[bytes] = set()
            for tokens in _pieces(text.as_py()):
                n.update(tokens)
                mine.update(tokens)
            docs.update(mine)
            size += len(n)
            if size > most:
                yield from out()
                size = 0
    yield from out()


def counts(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """Rows (lang, term, source, n, in_lang, first): counts above zero of the terms that a language keeps;
    ``in_lang`` is the term's count there, ``first`` is 1 in one row of each (lang, term)."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(lambda batches: _count(batches, held), "lang string, source string, term string, n bigint, docs bigint")
    # dealt out by (lang, term) once: the sum per source, the sums per term and the filter need no other shuffle
    by_source = (
        found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    term = Window.partitionBy("lang", "term")
    return (
        by_source.select(
            "lang",
            "term",
            "source",
            "n",
            F.sum("n").over(term).alias("in_lang"),
            F.sum("docs").over(term).alias("in_docs"),
            (F.row_number().over(term.orderBy("source")) == 1).cast("int").alias("first"),
        )
        .where(F.col("in_docs") >= min_docs)
        .drop("in_docs")
    )


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (lang, source, row, total, terms, in_lang): a language's groups in order, their counts' sum, the
    number of terms kept there and the sum of all its counts."""
    empty = F.lit("")
    every = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    joined = every.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    lang = Window.partitionBy("lang")
    return joined.select(
        "lang",
        "source",
        (F.row_number().over(lang.orderBy("source")) - 1).alias("row"),
        "total",
        F.sum("firsts").over(lang).alias("terms"),
        F.sum("total").over(lang).alias("lang_total"),
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _scaled(a: Column, d: Column) -> Column:
    """1 + floor(10^9 a / d) without leaving 64 bits: 10^9 = 31250 * 32000."""
    first = a * F.lit(31250)
    return F.lit(1) + _div(first, d) * F.lit(32000) + _div((first % d) * F.lit(32000), d)


def shares(n: np.ndarray, over: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (n + 1) / over)`` in 64 bits, for counts below 10^14."""
    first = (n + 1) * 31250
    return 1 + first // over * 32000 + first % over * 32000 // over


class Tree:
    """k^2-trees of the squares of one tile: per level the quadrants' bits of the nodes there, and leaf blocks."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: np.ndarray, side: int, squares: int) -> None:
        depth = (side // LEAF).bit_length() - 1
        r, c = row // LEAF, column % side // LEAF
        key = column // side
        keys = [key]
        for level in range(depth):
            shift = depth - 1 - level
            key = key << 2 | (r >> shift & 1) << 1 | (c >> shift & 1)
            keys.append(key)
        nodes = [np.unique(k) for k in keys]
        self.root = np.full(squares, -1)
        self.root[nodes[0]] = np.arange(len(nodes[0]))
        self.below: list[np.ndarray] = []  # number of each quadrant's node on the next level, or -1
        for above, here in zip(nodes, nodes[1:]):
            child = np.full(len(above) * 4 + 4, -1)  # four more: the quadrants of an empty quadrant are empty
            child[np.searchsorted(above, here >> 2) * 4 + (here & 3)] = np.arange(len(here))
            self.below.append(child)
        self.blocks = np.zeros((len(nodes[-1]) + 1, LEAF, LEAF), np.int64)  # the last one is the empty leaf
        self.blocks[np.searchsorted(nodes[-1], keys[-1]), row % LEAF, column % LEAF] = n

    def children(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        return self.below[level][np.where(node < 0, len(self.below[level]) // 4 - 1, node) * 4 + quadrant]


def compare(a: Tree, b: Tree, over_a: np.ndarray, over_b: np.ndarray, side: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the tile's columns of (p - q)^2 / q with p from rows of a and q from rows of b, and the other way
    round with q from a; both indexed [row of a, row of b]. ``over_*`` are the rows' denominators."""
    squares, depth = len(a.root), (side // LEAF).bit_length() - 1
    empty = np.zeros((side, side), np.int64)  # columns that both rows lack, by quadrants priced as a whole
    zero_a, zero_b = shares(np.zeros(side, np.int64), over_a), shares(np.zeros(side, np.int64), over_b)

    i = j = np.zeros(squares, np.int64)
    c, x, y = np.arange(squares), a.root, b.root
    size = side
    for level in range(depth + 1):
        bare = (x < 0) & (y < 0)
        if bare.any():
            width = np.clip(columns - c[bare] * size, 0, size)
            grid = np.zeros((side // size, side // size), np.int64)
            np.add.at(grid, (i[bare], j[bare]), width)
            empty += np.repeat(np.repeat(grid, size, axis=0), size, axis=1)
        i, j, c, x, y = (v[~bare] for v in (i, j, c, x, y))
        if level == depth:
            break
        size //= 2
        down, right, over = (np.tile(v, len(i)) for v in np.indices((2, 2, 2)).reshape(3, 8))
        i, j, c, x, y = (np.repeat(v, 8) for v in (i, j, c, x, y))
        x, y = a.children(level, x, down * 2 + over), b.children(level, y, right * 2 + over)
        i, j, c = i * 2 + down, j * 2 + right, c * 2 + over

    leaves = side // LEAF
    out = [np.zeros((leaves * leaves, LEAF, LEAF), np.int64) for _ in range(2)]
    order = np.argsort(i * leaves + j, kind="stable")
    for start in range(0, len(order), 2048):
        some = order[start : start + 2048]
        rows_a, rows_b = (k[some, None] * LEAF + np.arange(LEAF) for k in (i, j))
        p = shares(a.blocks[x[some]], over_a[rows_a][:, :, None])[:, :, None, :]
        q = shares(b.blocks[y[some]], over_b[rows_b][:, :, None])[:, None, :, :]
        square = (p - q) ** 2
        square *= (c[some, None] * LEAF + np.arange(LEAF) < columns)[:, None, None, :]
        place = (i * leaves + j)[some]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        for table, by in zip(out, (q, p)):
            table[place[first]] += np.add.reduceat((square // by).sum(axis=3), first, axis=0)
    square = (zero_a[:, None] - zero_b[None, :]) ** 2
    flat = [t.reshape(leaves, leaves, LEAF, LEAF).transpose(0, 2, 1, 3).reshape(side, side) for t in out]
    return flat[0] + empty * (square // zero_b[None, :]), flat[1] + empty * (square // zero_a[:, None])


_TILE = ["lang", "block", "low", "high"]
_SUMS = "lang string, source string, item string, terms bigint, bare bigint, value bigint, columns bigint"


def _tile(table: pa.Table, height: int) -> pa.Table:
    """Pairs of the groups of one tile of ``height`` rows: their price over its columns, one absent term's price, and its columns."""
    lang = table.column("lang")[0].as_py()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    here = table.filter(pc.is_null(table.column("term")))
    cells = table.filter(pc.is_valid(table.column("term")))
    names, members = here.column("source").to_pylist(), here.column("row").to_numpy()
    terms = int(here.column("terms")[0].as_py())
    totals = here.column("n").to_numpy()

    coded = cells.column("term").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    columns = len(coded.dictionary)
    rank = np.empty(columns, np.int64)  # terms of many groups first, so that what is empty lies together
    rank[np.argsort(-np.bincount(code, minlength=columns), kind="stable")] = np.arange(columns)
    row, n = cells.column("row").to_numpy(), cells.column("n").to_numpy()
    most = max(int((members % height).max(initial=0)) + 1, LEAF)
    side = 1 << (most - 1).bit_length()
    squares = max(1, -(-columns // side))

    def part(block: int) -> tuple[Tree, np.ndarray, dict[int, str]]:
        mine = row // height == block
        tree = Tree(row[mine] % height, rank[code[mine]], n[mine], side, squares)
        over = np.ones(side, np.int64)
        inside = members // height == block
        over[members[inside] % height] = np.maximum(totals[inside] + terms, 1)
        return tree, over, {int(m) % height: s for m, s, k in zip(members, names, inside) if k}

    a, over_a, named_a = part(low)
    b, over_b, named_b = part(high) if high != low else (a, over_a, named_a)
    forth, back = compare(a, b, over_a, over_b, side, columns)
    zero = np.zeros(side, np.int64)
    p, q = shares(zero, over_a)[:, None], shares(zero, over_b)[None, :]
    found = {k: [] for k in ("source", "item", "bare", "value")}
    at_a, at_b = np.array(list(named_a), np.int64), np.array(list(named_b), np.int64)
    src_a, src_b = list(named_a.values()), list(named_b.values())
    both = [(forth, (p - q) ** 2 // q, False)] + ([(back, (p - q) ** 2 // p, True)] if high != low else [])
    for value, bare, turned in both:
        for r, s in zip(at_a, src_a):
            other = at_b[at_b != r] if high == low else at_b
            items = [t for t, k in zip(src_b, at_b) if high != low or k != r]
            found["source"] += items if turned else [s] * len(items)
            found["item"] += [s] * len(items) if turned else items
            found["bare"].append(bare[r, other])
            found["value"].append(value[r, other])
    size = len(found["source"])
    flat = lambda k: pa.array(np.concatenate(found[k]) if found[k] else zero[:0], pa.int64())
    return pa.Table.from_arrays(
        [
            pa.array([lang] * size, pa.string()),
            pa.array(found["source"], pa.string()),
            pa.array(found["item"], pa.string()),
            pa.array([terms] * size, pa.int64()),
            flat("bare"),
            flat("value"),
            pa.array([columns] * size, pa.int64()),
        ],
        ["lang", "source", "item", "terms", "bare", "value", "columns"],
    )


def pairs(kept: DataFrame, known: DataFrame, height: int = ROWS, width: int = WIDTH) -> DataFrame:
    """Rows (lang, source, item, value): the divergence of every group from every other of its language."""
    blocks = F.greatest(F.ceil(F.col("terms") / width), F.lit(1)).cast("int")
    part = F.col("row") / F.lit(height)
    strips = (F.floor(F.col("last") / F.lit(height)) + 1).cast("int")
    sized = known.withColumn("last", F.max("row").over(Window.partitionBy("lang"))).select(
        "lang", "source", "row", "total", "terms", blocks.alias("blocks"), strips.alias("strips"), F.floor(part).cast("int").alias("strip")
    )
    spread_groups = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    cells = (
        kept.withColumn("salt", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SALT)).cast("int"))
        .join(spread_groups, ["lang", "source", "salt"])
        .select(
            "lang",
            F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
            "strips",
            "strip",
            "row",
            F.lit(None).cast("string").alias("source"),
            "term",
            "n",
            "terms",
        )
    )
    heads = sized.select(
        "lang",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "strips",
        "strip",
        "row",
        "source",
        F.lit(None).cast("string").alias("term"),
        F.col("total").alias("n"),
        "terms",
    )
    # a strip of groups meets every strip, itself included
    meets = cells.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    tiles = meets.select(
        "lang",
        "block",
        F.least("strip", "other").alias("low"),
        F.greatest("strip", "other").alias("high"),
        "row",
        "source",
        "term",
        "n",
        "terms",
    )
    sums = tiles.groupBy(*_TILE).applyInArrow(lambda table: _tile(table, height), _SUMS)
    return (
        sums.groupBy("lang", "source", "item", "terms", "bare")
        .agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"))
        .select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("columns")) * F.col("bare")).alias("value"))
    )


def overused(kept: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): the terms that a group uses more than its language does."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = kept.withColumn("salt", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SALT)).cast("int")).join(
        salted, ["lang", "source", "salt"]
    )
    one = F.lit(1).cast("bigint")
    both = joined.select(
        "lang",
        "source",
        F.col("term").alias("item"),
        _scaled(F.col("n") + one, F.col("total") + F.col("terms")).alias("p"),
        _scaled(F.col("in_lang") + one, F.col("lang_total") + F.col("terms")).alias("q"),
    ).where("p > q")
    return both.select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))


@tidy
def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, height: int = ROWS, width: int = WIDTH, held: int = HELD
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` ranks all other sources by divergence, part
    ``term`` the ``top`` terms that set a source apart from its language."""
    kept = stored(counts(docs, min_docs, held), "group-term-counts")
    known = stored(groups(docs, kept), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    others = pairs(kept, known, height, width).withColumn("rank", rank)
    terms = overused(kept, known).withColumn("rank", rank).where(F.col("rank") <= top)
    return shape(others, "pair").unionByName(shape(terms, "term"))
