"""Statistics by plain Python, trees by loops, splits by trying all, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import quality as Q

SF = "/root/testdata/sf0.01"


def plainly(text):
    """The numbers of NAMES, word by word. text: bytes whose white space is that of bytes.split()."""
    space = b" \t\n\x0b\x0c\r"
    words = text.split()
    fold = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines = [x for x in text.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split(b"\n") if x]
    kind = lambda b: next(k for k, f in (("other", b > 127), ("upper", 65 <= b <= 90), ("lower", 97 <= b <= 122), ("digit", 48 <= b <= 57), ("space", bytes([b]) in [bytes([s]) for s in space] or 28 <= b <= 31), ("stop", b in b".,;:"), ("shout", b in b"!?"), ("quote", b in b"'\"()-"), ("symbol", True)) if f)
    n, w, m = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    kinds = Counter(kind(b) for b in text)
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    pairs = list(zip(fold, fold[1:]))
    counts = Counter(fold)
    letter = lambda x: any(kind(b) in ("upper", "lower", "other") for b in x)
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), *(kinds[k] / n for k in Q.KINDS), kinds["upper"] / max(kinds["upper"] + kinds["lower"], 1), mean, math.sqrt(max(sum(s * s for s in sizes) / w - mean * mean, 0)),
        sum(s <= 2 for s in sizes) / w, sum(s >= 20 for s in sizes) / w, len(counts) / w, max(counts.values(), default=0) / w, sum(a == b for a, b in pairs) / w, len(set(pairs)) / max(len(pairs), 1), sum(not letter(x) for x in words) / w,
        sum(kind(x[-1]) in ("symbol", "shout") for x in words) / w, sum(kind(x[-1]) == "stop" for x in words) / w, math.log1p(len(text) / m), len(set(lines)) / m, sum(kind(x[-1]) == "stop" for x in lines) / m,
        -sum(c / n * math.log2(c / n) for c in Counter(text).values()), len(set(text)) / 256,
    ]


def test_statistics():
    rng = random.Random(2)
    texts = [b"", b" \n ", b"one", "Été FIN!! zwei-drei, 3 | 4\n\nzwei zwei.".encode(), b"a " * 500, b"x" * 3000]
    texts += ["".join(rng.choice("ab AB\n.,!?'\"9é|$\t") for _ in range(rng.randint(1, 400))).encode() for _ in range(200)]
    for t in texts:
        assert Q.statistics(t) == pytest.approx(plainly(t), abs=1e-9), t
    # stretches that end at white space change nothing but for what crosses lines
    long = b"some words of a line\n" * 400
    assert Q.statistics(long, 2100) == pytest.approx(plainly(long), abs=1e-9)
    assert len(Q.statistics(b"y" * 5000, 1000)) == len(Q.NAMES)


def walked(forest, row):
    """Every tree from its root, one node after the other."""
    total = forest.bias
    for at in forest.roots:
        while forest.child[at] != at:
            at = forest.child[at] + (row[forest.feature[at]] > forest.threshold[at])
        total += forest.value[at]
    return total


def test_trees_walk_like_loops():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    forest = Q.fit(x, y)
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.98
    for k in range(0, 600, 40):
        assert forest.raw(x[k : k + 1])[0] == pytest.approx(walked(forest, x[k]))
    assert len(forest.value) <= Q.TREES * 2 ** (Q.DEPTH + 1) and forest.raw(np.zeros((0, 5))).shape == (0,)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x, weight = rng.integers(0, 9, size=(80, 3)).astype(float), rng.integers(1, 3, size=80).astype(float)
    y = (x[:, 2] + rng.normal(size=80) > 4).astype(float)
    forest = Q.fit(x, y, weight, trees=1, depth=1)
    p = (weight * y).sum() / weight.sum()
    g, h = weight * (p - y), weight * p * (1 - p)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + Q.PENALTY)
    gains = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) for f in range(3) for c in Q.cuts_of(x[:, f]) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= Q.LEAST_WEIGHT}
    best = max(gains, key=gains.get)
    assert (forest.feature[0], forest.threshold[0]) == best
    left = x[:, best[0]] <= best[1]
    assert forest.value[1] == pytest.approx(-Q.RATE * g[left].sum() / (h[left].sum() + Q.PENALTY)) and forest.value[2] == pytest.approx(-Q.RATE * g[~left].sum() / (h[~left].sum() + Q.PENALTY))


def test_odd_fits():
    x = np.ones((4, 2))
    assert Q.fit(x, np.ones(4)).scores(x).tolist() == pytest.approx([1.0] * 4) and Q.fit(x, np.zeros(4)).scores(x).tolist() == pytest.approx([0.0] * 4)
    assert Q.fit(x, np.array([0.0, 1, 1, 1])).scores(x).tolist() == pytest.approx([0.75] * 4)  # nothing to split at
    assert Q.fit(np.zeros((0, 2)), np.zeros(0)).scores(x).tolist() == [0.5] * 4
    many = np.linspace(0, 1, 1000)
    assert len(Q.cuts_of(many, 64)) == 63


def test_held_out_quality(spark):
    """What the query gives for documents whose labels were not learned; scores of rows by their own statistics."""
    got = {r.doc_id: r for r in Q.op11_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i].score, y, got[i].predicted) for i, y in labels.items() if got[i].held_out and y is not None]
    good, bad = ([s for s, y, _ in held if y == v] for v in (1, 0))
    assert len(held) > 50 and bad
    assert sum(p == y for _, y, p in held) / len(held) > 0.95
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.98
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~Q.held_out()))
    for r in docs.where("doc_id % 97 = 0").collect():
        own = 1 / (1 + math.exp(-walked(forest, Q.statistics((r.text or "").encode()))))
        assert got[r.doc_id].score == pytest.approx(own) and got[r.doc_id].predicted == (own >= 0.3)


def test_hard_rows(spark, docs, none, hard):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 130)] + [(None, 1), (3, None), (60, 1), (60, 1)], "doc_id long, quality int")
    forest = Q.train(docs, labels)
    rows = Q.scored(docs, forest).collect()
    assert len(rows) == len(hard) and all(0 <= r.score <= 1 for r in rows)
    want = sorted((i is not None, i or 0, round(1 / (1 + math.exp(-walked(forest, Q.statistics((t or "").encode())))), 9)) for i, t in hard)
    assert sorted((r.id is not None, r.id or 0, round(r.score, 9)) for r in rows) == want
    assert Q.scored(none, forest).count() == 0
    few = Q.train(docs, labels, sample=10)
    assert 0 < Q.scored(docs, few).agg(F.avg("score")).first()[0] < 1
    assert {r.score for r in Q.scored(docs, Q.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {round(r.score, 6) for r in Q.scored(docs, Q.train(none, labels)).collect()} == {0.5}
