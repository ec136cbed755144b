import random
from collections import Counter
from hashlib import sha256

from lanternlog.llm import suffix_dedup as S


def brute(texts, span=S.SPAN):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(rng, n, hot):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    shared = [prose(60) for _ in range(4)]
    texts = [None, "", "x", "und " * 200, "und " * 90, "a" * 199, "a" * 200, "a" * 500]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and len(texts) > 10:
            base = rng.choice(texts[8:]).split(" ")
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(prose(rng.randint(1, 120)) + (" " + rng.choice(shared) + " " if kind < 0.6 else "") + prose(rng.randint(0, 60)))
    return texts + [prose(3) + rng.choice("xyz") + shared[0] + prose(3) for _ in range(hot)]


def test_suffix_array_equals_sorting():
    rng = random.Random(0)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.report(docs.withColumn("key", docs.doc_id)).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1), 120, 0))


def test_crowded_passage_is_split(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 8)
    check(spark, corpus(random.Random(2), 40, 60))


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b " * 100), (None, "a b " * 100), (3, None)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in S.report(docs).collect()) == [0, 400, 400]
    assert S.report(docs.limit(0)).count() == 0


def test_long_text_in_pieces(spark):
    """A text longer than a slice, whose repeats lie across its cuts, beside another that shares a passage."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = noise(700)
    cut = S._SLICE
    long = noise(cut - 300) + shared + noise(cut // 3) + shared + noise(50)
    check(spark, [long, noise(400) + shared[100:600], noise(900), "é" * 120 + noise(90)])


def test_pieces_cover_all_windows():
    at = S.np.array([0, 10, 10, S._SLICE * 3 + 7, S._SLICE * 3 + 400])
    got = list(S._pieces(S.np.zeros(at[-1], S.np.uint8), at))
    long = [(a, b) for i, j, a, b in got if (i, j) == (2, 3)]
    starts = sorted(w for a, b in long for w in (a, b - S.SPAN))
    assert starts[0] == 10 and starts[-1] == S._SLICE * 3 + 7 - S.SPAN
    assert all(later[0] == earlier[1] - S.SPAN + 1 for earlier, later in zip(long, long[1:]))


def test_equal_hashes_are_not_equal_texts(spark, monkeypatch):
    """Filters that let everything through, as equal hashes would, change nothing."""
    monkeypatch.setattr(S, "bits_of", lambda ids, column: S.np.full(8, 2**64 - 1, S.np.uint64))
    check(spark, corpus(random.Random(9), 40, 0))
