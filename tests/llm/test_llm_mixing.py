"""Mixing against brute force and the conditions a mix has to meet."""

import random
from itertools import product

import nasty
import pytest

from reviewlake.llm import mixing


def test_targets():
    sizes = {"a": 100, "b": 10, "c": 50, None: 0}
    got = mixing.targets(sizes, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5, 2)
    assert got == {"a": 132.0, "b": 20.0, "c": 88.0, None: 0.0}
    assert sum(got.values()) == 240


@pytest.mark.parametrize("seed", range(6))
def test_flow_costs_least(seed):
    """Against all ways to route whole words between two patterns of overlapping sources."""
    rng = random.Random(seed)
    supply = [rng.randrange(4), rng.randrange(4), rng.randrange(3)]
    members = [[0], [0, 1], [1]]
    quota = [rng.randrange(5), rng.randrange(5)]
    flow = mixing.min_cost_flow(supply, members, quota, 2)

    def cost(f):
        return sum(max(0, x - n) for x, n in zip(f, supply))

    ways = [
        (a, b0 + b1, c)
        for a, b0, b1, c in product(range(7), repeat=4)
        if a <= 2 * supply[0] and b0 + b1 <= 2 * supply[1] and c <= 2 * supply[2] and a + b0 <= quota[0] and b1 + c <= quota[1]
    ]
    most = max(map(sum, ways))
    assert sum(flow) == most
    assert cost(flow) == min(cost(w) for w in ways if sum(w) == most)


def test_nasty_rows(spark):
    docs = nasty.documents(spark)
    rows = mixing.mix(docs, [3, 1, 2]).collect()
    assert len(rows) == len(nasty.ROWS)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
    for r, (i, t, _, s) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.size)), sorted(nasty.ROWS, key=lambda x: (str(x[0]), len((x[1] or "").split())))):
        assert r.size == len((t or "").encode().split()) and r.doc_id == i
        of = by.setdefault(s, [0, r.target, r.source_size, 0])
        of[0] += r.taken
        of[3] += r.size
    for taken, target, own, size in by.values():
        assert own == size and abs(taken - target) <= 1 + (own == 0)
    again = mixing.mix(docs, [3, 1, 2]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    copies = mixing.mixture(docs, [3, 1, 2])
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in rows)
    assert mixing.mix(nasty.empty(spark), [3, 1, 2]).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 7), ["x"] if i % 3 == 0 else ["x", "y"] if i % 3 == 1 else ["y", None]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df, [1, 1, 2]).collect()
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 3
    assert all(r.taken <= 2 * r.size for r in got)
