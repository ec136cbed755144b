import math
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from lanternlog.llm import decontaminate, jaccard_join, neighbours

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contaminated(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item_id))
        ids = sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Wort", "été", "x1", "the", "of", "a"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, prose(rng.randint(1, 40))) for k in range(30)] + [(100, None), (101, ""), (102, "--"), (9, "the of")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, items[0][1]), (3, items[0][1]), (4, prose(3000))]
    for k in range(5, 60):
        planted = rng.choice(items)[1] or ""
        docs.append((k, f"{prose(rng.randint(0, 200))}, {planted.upper()}; {prose(rng.randint(0, 200))}"))
    left = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item_id string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = [tuple(r) for r in decontaminate.report(left, right).select(*columns).collect()]
    assert sorted(got) == sorted(contaminated(docs, items))
    none = decontaminate.report(left, right.where("false")).where("n_hit > 0 or contaminated")
    assert none.count() == 0
    assert decontaminate.report(left.where("false"), right).count() == 0


def components(docs, n, percent):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))})
    label = list(range(len(docs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted((doc_id, len(sets[k]), least[root(k)]) for k, (doc_id, _) in enumerate(docs))


def test_crowded_regions_are_divided_exactly(spark, monkeypatch):
    """A large group of near copies, some far from its centre, through pivots, windows and blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "WIDE", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 400)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            own[rng.randrange(60)] = f"e{rng.randrange(6)}"
        docs.append((k, " ".join(own[rng.choice([0, 0, 3]) :])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for n, percent in ((4, 85), (5, 80)):
        got = [tuple(r) for r in jaccard_join.join(frame, n, percent).select("doc_id", "n_shingles", "component_id").collect()]
        assert sorted(got) == components(docs, n, percent)


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four"]
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(10):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=4)) for _ in range(70)]  # one crowded region
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int")
    got = [tuple(r) for r in jaccard_join.join(table).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == components(docs, 4, 85)


def test_neighbours_recall_and_exact_scores(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(k, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for k in range(1500)]
    rows += [(1500, None), (1600, [0.0] * 16), (1601, [math.nan] * 16), (1602, [math.inf] * 16), (1603, rows[100][1]), (1604, rows[100][1])]
    got = neighbours.report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    usable = rows[:1500] + rows[-2:]
    hits = 0
    queries = [(k, v) for k, v in usable if k % 100 == 0]
    vectors = dict(usable)
    for q, v in queries:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert math.isclose(r["score"], math.dist(v, vectors[r["vec_id"]]), rel_tol=1e-12, abs_tol=1e-12)
        best = sorted((math.dist(v, u), k) for k, u in usable if k != q)[:10]
        hits += len({k for _, k in best} & {r["vec_id"] for r in mine})
    assert len(got) == 10 * len(queries)
    assert hits >= 0.9 * 10 * len(queries)


def _recall(rows, got, every=100, k=10):
    """Share of the true neighbours found; checks scores and order on the way."""
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        away = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, away)) if ids[i] != ids[q]][:k]
        found = mine[int(ids[q])]
        assert len(found) == len(order) and found == sorted(found)
        exact = dict(zip(ids.tolist(), away.tolist(), strict=True))
        assert all(math.isclose(s, exact[v], rel_tol=1e-12, abs_tol=1e-12) for s, v in found)
        hits += len({v for _, v in found} & {int(ids[i]) for i in order})
        total += len(order)
    return hits / total


@pytest.mark.parametrize("kind", ["random", "grouped", "hot"])
def test_neighbours_over_many_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "SHARD", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    monkeypatch.setattr(neighbours, "TASKS", 7)
    rng = np.random.default_rng(3)
    if kind == "random":
        vectors = rng.standard_normal((1500, 64))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    else:
        vectors = rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)] * 4 + rng.standard_normal((1500, 16)) * 0.2
    if kind == "hot":
        vectors[rng.permutation(1500)[:500]] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    got = neighbours.report(table, every=25).collect()
    assert _recall(rows, got, every=25) >= 0.95


def test_cells_out_of_reach_are_left_out():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 8)) * 10
    own = rng.integers(0, 40, 400)
    vectors = centres[own] + rng.standard_normal((400, 8)) * 0.3
    farthest = np.array([np.sqrt(((vectors[own == c] - centres[c]) ** 2).sum(1)).max() for c in range(40)])
    limit = np.full(400, 1.5)
    row, cell = neighbours.within_reach(vectors, limit, own, centres, farthest)
    assert len(row) < 400 * 4
    reached = set(zip(row.tolist(), cell.tolist(), strict=True))
    for q in range(400):
        for v in np.flatnonzero(np.sqrt(((vectors - vectors[q]) ** 2).sum(1)) <= 1.5):
            assert own[v] == own[q] or (q, own[v]) in reached
    everywhere = neighbours.within_reach(vectors, np.full(400, np.inf), own, centres, farthest)
    assert len(everywhere[0]) == 400 * 39


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, rank int, query_id string"
    assert neighbours.report(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.report(spark.createDataFrame([(1, [1.0], 1, "a"), (None, [2.0], 1, None)], schema)).count() == 0
    big = [(0, [1e200, 0.0], 1, ""), (1, [-1e200, 1.0], 1, ""), (2, [1e308, 1e308], 1, ""), (100, [1e200, 0.0], 1, ""), (100, [1e200, 0.0], 2, "")]
    got = neighbours.report(spark.createDataFrame(big, schema)).collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0][:2] == [100, 100]  # repeated rows are rows
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 100) == [0, 1, 2]
    few = neighbours.report(spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (7, [1.0, 1.0], 0, ""), (5, [1.0, -1.0], 0, "")], schema))
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(0, 1, 5, 1.0), (0, 2, 7, 1.0)]


def test_decontamination_in_many_passes(spark, monkeypatch):
    """A benchmark of many blocks, two in a pass, finds what one block finds."""
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices(["Wort", "été", "x1", "the", "of", "a"], k=n))
    items = [(k, prose(rng.randint(1, 30))) for k in range(25)]
    docs = [(k, f"{prose(20)} {rng.choice(items)[1]} {prose(9)}") for k in range(40)] + [(99, None)]
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.judge(decontaminate.matches(left, right, block_bytes=900))
    got = [(r["doc"]["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) for r in found.collect()]
    assert sorted(got) == sorted((d, n, h, i, c) for d, n, h, i, _, c in contaminated(docs, items))


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_long_words_that_fool_polynomials(spark):
    """The Thue-Morse word and its mirror have one hash modulo any power of two."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(k, " ".join([w] * 4)) for k, w in enumerate([one, other, one[:-1], "x" * 300, "x" * 301])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(table).collect()}
    assert got == {k: k for k in range(5)}
    items = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.report(table, items).where("contaminated").collect()] == [0]


def test_hashes_of_ranges():
    """Equal for equal bytes wherever they stand, different for all different ranges of a small text."""
    import numpy as np

    from lanternlog.llm import bytes as B

    text = np.frombuffer(b"abababab" * 40 + b"\0" * 30 + b"abababab" * 40, np.uint8)
    start, end = np.triu_indices(len(text) + 1)
    named: dict[bytes, int] = {}
    for a, b, h in zip(start[::7], end[::7], B.hashes(text, start[::7], end[::7]).tolist()):
        assert named.setdefault(text[a:b].tobytes(), h) == h
    assert len(set(named.values())) == len(named)
