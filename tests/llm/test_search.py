"""Hard negatives and phrases against brute force, neighbours by recall; odd rows, ties and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from palimpsest.llm import ann, hardneg, phrases, pii
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, rank string"


def plain_negatives(rows, every, scale=256, k=5, m=3):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, anchors = [], {}
    for i, v, lab in sorted(ok, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, lab))
    for a, (v, lab) in anchors.items():
        ranked = sorted((-score(v, w), i, other) for i, w, other in ok if i != a)
        for ps, p, _ in [x for x in ranked if x[2] == lab][:k]:
            fits = [(s, i) for s, i, other in ranked if other != lab and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits[:m])]
    return sorted(out)


def vector_rows(n, dim, draw, copies=0):
    """Clustered vectors; ``copies`` of them are one vector, which ties."""
    centers = draw.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centers[i % 6] + draw.normal(size=dim) * (0.2 if i % 2 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(draw.integers(0, 4))))
    for i in range(copies):
        rows[3 * i] = (rows[3 * i][0], rows[0][1], rows[3 * i][2])
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = vector_rows(700, 8, np.random.default_rng(1), copies=60)
    rows += [(None, [1.0] * 8, 1), (10, None, 1), (20, [], 1), (30, [1.0, None], 2), (40, [float("nan")] * 8, 0), (50, [float("inf")] * 8, 0), (60, [0.5] * 8, None), (70, [0.25] * 3, 2), (80, [0.0] * 8, 1), (80, [3.0] * 8, 1), (90, [-1.0] * 8, 3)]
    d = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    want = plain_negatives(rows, 10)
    for sizes in ({}, {"block_rows": 40, "anchor_rows": 9, "sample_rows": 100}):
        got = hardneg.mine(d, every=10, **sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 300


def test_hard_negatives_of_odd_tables(spark):
    d = spark.createDataFrame([], VECTORS)
    assert hardneg.mine(d).count() == 0 and hardneg.mine(spark.createDataFrame([(1, [1.0], 1, "")], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.5], i % 2, "") for i in range(100)], VECTORS)
    assert hardneg.mine(same, every=50).count() == 0  # equal scores are above 95 of 100
    # Products that doubles don't hold: the score of the last two ends in an odd number.
    far = [(i, [float(i) * 3e7 + i % 3, -(2.0**27) - i], i % 2) for i in range(60)]
    d = spark.createDataFrame([(*r, "") for r in far], VECTORS.replace("float", "double"))
    assert sorted(map(tuple, hardneg.mine(d, every=20, scale=1.0, block_rows=16).collect())) == plain_negatives(far, 20, scale=1) != []


def test_bounds_hold(spark):
    """No row is nearer or further than what the tree says of its bucket."""
    draw = np.random.default_rng(3)
    x = np.floor(draw.normal(size=(500, 6)) * 50)
    most = (x * x).sum(axis=1).max()
    order, vantage, path, low, high, cut = hardneg.grow(hardneg.augmented(x, most))
    q = x[:20]
    top, least = hardneg._bounds(hardneg._to_vantage(q, vantage), path, low, high, (q * q).sum(axis=1) + most)
    s = q @ x[order].T
    for b in range(len(cut) - 1):
        own = s[:, cut[b] : cut[b + 1]]
        assert (own.max(axis=1) <= top[:, b]).all() and (own.min(axis=1) >= least[:, b]).all()
    assert sorted(order) == list(range(500)) and (top < s.max(axis=1)[:, None]).any()
    v, radius = hardneg.plant(hardneg.augmented(x, most), 3)
    cell, _ = hardneg.descend(hardneg.augmented(x, most), v, radius, 3)
    assert np.bincount(cell, minlength=8).min() > 30


def exact(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = (x * x[n]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_reach_their_recall(spark, clustered):
    draw = np.random.default_rng(7)
    rows = vector_rows(6000, 16, draw, copies=40) if clustered else [(i, [float(np.float32(x)) for x in draw.normal(size=16)], 0) for i in range(6000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got: dict = {}
    for r in ann.search(d, block_rows=500, query_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hit = exact(rows, 20, 20), 0
    assert set(got) == set(want)
    scores = {}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        scores[q] = {f[1]: f[2] for f in found}
        hit += len(set(scores[q]) & {i for i, _ in want[q]})
        assert all(abs(scores[q][i] - s) < 1e-12 for i, s in want[q] if i in scores[q])
    assert hit >= 0.9 * 20 * len(want)


def test_neighbours_of_odd_tables(spark):
    assert ann.search(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [1.0, 0.0], 0, ""), (0, [1.0, 0.0], 0, ""), (0, [0.0, 1.0], 0, ""), (1, [0.0, 0.0], 0, ""), (2, None, 0, ""), (3, [], 0, ""), (4, [float("nan"), 0.0], 0, ""), (5, [2.0], 0, ""), (6, [2.0, 5.0], 0, ""), (7, [None, 1.0], 0, ""), (8, [2.0, 0.0], 0, "")]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, VECTORS)).collect()))
    # The least vector of id 0 asks; all others but its own rows are candidates.
    assert got == [(0, 1, 6, 5.0), (0, 2, 5, 0.0), (0, 3, 8, 0.0)]
    few = [(i, [float(i), 1.0], 0, "") for i in range(30)]
    assert ann.search(spark.createDataFrame(few, VECTORS), every=29).groupBy("query_id").count().collect()[0][1] == 20
    assert ann.search(spark.createDataFrame(few[:12], VECTORS)).count() == 11


def test_cut_graph_stays_balanced():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(100, 4)) * 0.1 + c for c in np.eye(4) * 3])
    near = ann._most(x, x, np.arange(400), 10)
    first = ann.halved(x, 2)
    label = ann.cut_graph(near, first, 4)
    cut = lambda y: (y[near] != y[:, None]).mean()
    assert np.bincount(label).max() <= 110 and cut(label) <= cut(first) and cut(label) < 0.05


def plain_phrases(rows, least, keep, covered=80):
    cut = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f: dict = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        t = (text or "").translate(cut)
        for c in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(c, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for k in range(1, 5):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if any(len(o) > len(p) and 100 * b >= covered * a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in many.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        n = sum(a for p, a in own.items() if len(p) == 1)
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    draw = random.Random(6)
    words = "a b c dé the THE The of x-1 日 \x1c\xa0z q".split(" ")
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(draw.randint(0, 60)))
    rows = [(draw.choice(["en", "de", None, "und", ""]), text()) for _ in range(150)] + [("en", None), ("en", ""), (None, None), ("de", "the of " * 400), ("en", "the of " * 400)]
    rows += rows[:30]
    d = spark.createDataFrame([(1, *r, "x") for r in rows], "doc_id long, lang string, text string, phrase string")
    want = plain_phrases(rows, 3, 40)
    for words_ in (1 << 20, 50, 4):  # pieces longer than a block are cut
        assert sorted(map(tuple, phrases.mine(d, least=3, keep=40, block_words=words_).collect())) == want
    assert len({w[0] for w in want}) == 4 and phrases.mine(d.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, whole = 9_000_000_000_000_003, 9_500_000_000_000_001
    d = spark.createDataFrame([(a, whole)], "a long, w long")
    assert d.select(phrases._score(F.col("a"), F.col("w")).alias("s")).first().s == 2_000_000 * a // whole


def test_the_classifier_of_personal_data_rejects(spark):
    """Of a corpus's candidates it keeps named secrets; long words, capitalised pairs and numbers of a wrong check digit go."""
    draw = random.Random(9)
    code = lambda n, marks: "".join(draw.choices(marks, k=n))
    texts = []
    for k in range(200):
        number = "4" + code(15, "0123456789")
        while pii.luhn(number):
            number = "4" + code(15, "0123456789")
        texts.append(f"Some Words {code(18, 'abcdefghij')} stand with token = '{''.join(code(1, 'abcdef') + code(1, '0123456789') for _ in range(20))}' and {number} of Other Kind {k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = Counter(s.split(":")[0] for r in pii.find(docs).collect() for s in r.spans.split(",") if s and s.split(":")[0] in pii.EXTRA)
    assert found == {"secret": 200}
    assert sum(len(pii.extra_candidates(t, pii.base_spans(t))) for t in texts) >= 5 * 200
    # However far its first digit is.
    long = "token = " + "Ab" * 30 + "9x8y7z6w5v 1"
    assert pii.extra_candidates(long, []) == [(8, "secret", 78)]
