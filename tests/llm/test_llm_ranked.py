"""Ranked search against scores of all documents."""

import random
import re
from collections import Counter

import nasty
import numpy as np

from reviewlake.llm import ranked


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked.TERM, low)


def brute(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(ranked.weight(df[t], n) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        best = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(best, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def text(most):
        return rng.choice([" ", ", ", "\n-"]).join(rng.choices(vocabulary, weights, k=rng.randint(0, most)))

    docs = [(i, text(50)) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (7, docs[7][1]), (None, None)]
    items = [(i, text(12)) for i in range(30)] + [(90, docs[3][1]), (90, docs[3][1]), (91, ""), (92, None), (None, "w1 w1 W1 w2"), (93, "unknown")]
    monkeypatch.setattr(ranked, "FIRST_READ", 4)
    monkeypatch.setattr(ranked, "DOCUMENTS", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(ranked.search(d, q)) == want
    monkeypatch.setattr(ranked, "ITEMS", 7)  # items in groups
    assert got(ranked.search(d, q)) == want


def test_reading_stops_when_all_is_known():
    """Every stop gives the exact best, with ties, whatever the lists are."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(int(rng.integers(0, 6))):
            docs = rng.permutation(size)[: int(rng.integers(0, size + 1))]
            scores = np.sort(rng.integers(0, 40, len(docs)))[::-1].astype(np.int64)
            total[docs] += scores
            lists.append((docs, scores))
        floor = int(rng.integers(0, 60))
        found, scores = ranked.nra(lists, size, k, floor)
        assert (scores == total[found]).all()
        kth = np.sort(total)[::-1][min(k, size) - 1]
        want = np.flatnonzero((total >= max(kth, floor, 1)) & (total > 0))
        assert set(want.tolist()) <= set(found.tolist())


def test_nasty_rows(spark):
    items = [(1, "word1 and2 THING"), (2, None), (3, "same row"), (4, "漢字 x"), (5, "x" * 70_000)]
    q = nasty.F.lit
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("score", q("clash")).withColumn("rank", q(1))
    docs = [(i, t) for i, t, _, _ in nasty.ROWS]
    assert got(ranked.search(nasty.documents(spark), df)) == brute(docs, items)
    assert ranked.search(nasty.empty(spark), df).count() == 0
    assert ranked.search(nasty.documents(spark), df.limit(0)).count() == 0
