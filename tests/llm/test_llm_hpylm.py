"""The language model: counts against brute force, seats against their distribution, scores against the base."""

import math
import random
import zlib
from collections import Counter

import nasty
import numpy as np

from reviewlake.llm import hpylm


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [None]


def out(key):
    return zlib.crc32((str(key) if key is not None else "").encode()) % 5 == 1


def check(rows, got):
    counts = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        words = tokens(x)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((str(i), out(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    mine = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(mine) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_nasty_rows(spark):
    got = hpylm.score(nasty.documents(spark)).collect()
    check([(i, t) for i, t, _, _ in nasty.ROWS], got)
    assert hpylm.score(nasty.empty(spark)).count() == 0


def test_pairs_of_words_are_learnt(spark):
    rng = random.Random(1)
    after = {f"w{i}": [f"w{rng.randrange(40)}" for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(40)}"]
        while len(words) < 60:
            words.append(rng.choice(after[words[-1]]) if rng.random() < 0.9 else f"rare{rng.randrange(5000)}")
            if words[-1] not in after:
                words.append(f"w{rng.randrange(40)}")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = hpylm.score(df).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    again = hpylm.score(df).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_probabilities_add_up():
    """The predictive rule over a vocabulary and one unknown word sums to one."""
    d, s, pd, ps = 0.6, 2.0, 0.5, 1.0
    counts, tables = np.array([5, 2, 1, 0]), np.array([2, 1, 1, 0])
    parent_c, parent_t = np.array([4, 3, 2, 2]), np.array([1, 1, 1, 1])
    rest = (ps + pd * parent_t.sum()) / 5
    p = np.append((parent_c - pd * parent_t + rest) / (ps + parent_c.sum()), rest / (ps + parent_c.sum()))
    assert abs(p.sum() - 1) < 1e-12
    stay = np.append(np.where(counts > 0, counts - d * tables, 0), 0)
    q = (stay + (s + d * tables.sum()) * p) / (s + counts.sum())
    assert abs(q.sum() - 1) < 1e-12


def test_tables_follow_their_distribution():
    d, c, b = 0.5, 5, 1.7
    stirling = hpylm.log_stirling(hpylm.EXACT, d)
    # All seatings one customer at a time, weighted.
    weights = Counter({(1,): 1.0})
    for _ in range(c - 1):
        new = Counter()
        for sizes, w in weights.items():
            new[tuple(sorted((*sizes, 1)))] += w
            for k in range(len(sizes)):
                new[tuple(sorted((*sizes[:k], sizes[k] + 1, *sizes[k + 1 :])))] += w * (sizes[k] - d)
        weights = new
    exact = np.zeros(c + 1)
    for sizes, w in weights.items():
        exact[len(sizes)] += w
    assert np.allclose(np.exp(stirling[c, 1 : c + 1]), exact[1:])
    exact *= b ** np.arange(c + 1)
    exact /= exact.sum()
    random_ = np.random.default_rng(0)
    t = hpylm.draw_tables(np.full(40_000, c), np.full(40_000, b), d, stirling, random_)
    assert np.abs(np.bincount(t, minlength=c + 1) / 40_000 - exact).max() < 0.01
    many = hpylm.draw_tables(np.array([0, 1, 64, 65, 100_000]), np.full(5, 0.3), d, stirling, random_)
    assert many[0] == 0 and many[1] == 1 and (many[2:] >= 1).all() and many[4] < 100_000


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint32), np.array([1.5], np.float32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, hpylm.unpack(hpylm.pack(*arrays))))
