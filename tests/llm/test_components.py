"""Connected components against union-find."""

import random

import pytest

from reviewlake.llm.common import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_roots_are_smallest_reachable(spark, kind):
    random.seed(5)
    edges = {
        "random": [(random.randrange(300), random.randrange(300)) for _ in range(160)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 60)] + [(59, 100)],
        "loops": [(1, 2), (2, 1), (1, 2), (7, 7)],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    want = {x: r for x, r in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
