"""Filter interaction and source divergence against their definitions, term by term and order by order."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlog.llm import divergence, filter_audit

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, mask string, part int"


def _audit(rows, labels):
    """Every order applied left to right, document by document."""
    first: dict[str, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, _, source, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        parts[source or ""].append((doc_id, {f for f, bad in fails.items() if bad}))
    out = set()
    for part, docs in parts.items():
        lines, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in bad for _, bad in docs)
                alone = sum(bad == {f} for _, bad in docs)
                shapley[f] += len(gone)
                lost = sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, *lost, f))
        out |= {(*line[:-1], shapley[line[-1]]) for line in lines}
    return out


def _texts(rng):
    words = ["a", "b", "Cc", "d%", "é", "The", "x" * 9, "|"]
    long = [" ".join(rng.choice(words + [str(k)]) for k in range(n)) for n in (200, 201, 199, 300, 450)]
    odd = [None, "", " \t\n", "A", " ", "one two", "B " * 250, " ".join(map(str, range(260))), "Ab " + "x " * 300]
    return long + odd


def test_filter_orders(spark):
    rng = random.Random(3)
    texts = _texts(rng)
    rows = []
    for k in range(300):
        doc_id = rng.choice([None, k, k, k, rng.randint(0, 40)])
        rows.append((doc_id, rng.choice(texts), "en", rng.choice(["s", "t", None, ""]), 1, "x", 2))
    rows += rows[:20]  # repeated rows
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(docs, marks).collect()]
    assert len(got) == len(set(got)) == 3 * 600
    assert set(got) == _audit(rows, labels)
    assert filter_audit.audit(docs.where("false"), marks).count() == 0
    assert {tuple(r) for r in filter_audit.audit(docs, marks.where("false")).collect()} == _audit(rows, [])


def test_filters_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 2), (2, "b", "en", "s", 1, "x", 2)], DOCS)
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    own = lambda text, tokens: {"P": text == "a", "Q": F.size(tokens) > 0}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(docs, marks, own).collect()}
    assert len(got) == 18
    assert got["PQE", 1] == (1, 1, 0, 0, 3) and got["PQE", 2] == (0, 1, 1, 1, 9)


def test_gray_code_states():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (3, 32, 3))
    states = filter_audit.survivors(cells)
    for subset in range(32):
        kept = [m for m in range(32) if not m & subset]
        assert (states[subset] == cells[:, kept].sum(axis=1)).all()


def test_many_parts(spark):
    """More parts than one slice, in one task."""
    docs = spark.range(3 * filter_audit.PARTS).selectExpr("id doc_id", "'same' text", "'en' lang", "concat('s', id) source").coalesce(1)
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, marks)
    assert got.count() == 3 * filter_audit.PARTS * 600
    assert got.where("filter_order = 'EABCD' and step = 1 and removed = 0").count() == 1


def _divergence(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    here, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(lower))
        groups[lang].add(source)
        here[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(here[lang, s]) for s in sources}
        q = shares(sum((here[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if here[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def _corpus(rng, sources, size, words):
    rows = []
    for k in range(size):
        text = " ".join(rng.choice(words) + rng.choice(["", ".", ",", "1"]) for _ in range(rng.choice([0, 1, 5, 40])))
        text = rng.choice([None, "", text, text, text, text.title()])
        rows.append((k, text, rng.choice(["en", "en", "fr", None]), rng.choice(sources), 1, "x", 2))
    return rows + [(999, "only one", "xx", "alone", 1, "x", 2), (None, None, "yy", None, 1, "x", 2), (None, "", "yy", "b", 1, "x", 2)]


@pytest.mark.parametrize("height, width, held", [(128, 2048, 200_000), (8, 16, 10)])
def test_divergence(spark, height, width, held):
    """Also with tiles of eight groups and about sixteen terms, where strips meet and much is empty."""
    rng = random.Random(5)
    words = ["the", "The", "É", "é", "naïve", "x y", "日本", "A-b", "don't"] + [f"w{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}{'xyz'[k % 3] * (k % 7)}" for k in range(60)]
    rows = _corpus(rng, [None, "", *[f"s{k}" for k in range(19)]], 260, words)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, height=height, width=width, held=held).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _divergence(rows)
    assert divergence.audit(docs.where("false")).count() == 0


def test_divergence_top_and_threshold(spark):
    rows = _corpus(random.Random(6), ["s", "t"], 60, [f"w{c}" for c in "abcdefghijklmnop"])
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in divergence.audit(docs, min_docs=1, top=3).collect()} == _divergence(rows, 1, 3)


def test_pieces():
    text = b"Abc d\xc3\xa9f 1x" * 50
    whole = [t for piece in divergence._pieces(text) for t in piece]
    old, divergence.PIECE = divergence.PIECE, 7
    try:
        assert [t for piece in divergence._pieces(text) for t in piece] == whole
    finally:
        divergence.PIECE = old


def test_large_counts():
    """Shares stay exact far beyond what a product with 10^9 would allow."""
    n, over = 12_345_678_901, 98_765_432_109_876
    got = divergence.shares(np.array([n]), np.array([over]))[0]
    assert got == 1 + 10**9 * (n + 1) // over


@pytest.mark.parametrize("side, columns, density", [(8, 5, 0.5), (32, 100, 0.02), (64, 64, 0.0), (16, 33, 1.0)])
def test_trees(side, columns, density):
    rng = np.random.default_rng(side)
    tables = [np.where(rng.random((side, columns)) < density, rng.integers(1, 50, (side, columns)), 0) for _ in range(2)]
    over = [t.sum(axis=1) + 300 for t in tables]
    squares = -(-columns // side)
    trees = [divergence.Tree(*np.nonzero(t), t[np.nonzero(t)], side, squares) for t in tables]
    forth, back = divergence.compare(*trees, *over, side, columns)
    p, q = (divergence.shares(t, o[:, None]) for t, o in zip(tables, over))
    for r in range(side):
        for s in range(side):
            square = (p[r] - q[s]) ** 2
            assert forth[r, s] == (square // q[s]).sum() and back[r, s] == (square // p[r]).sum()
