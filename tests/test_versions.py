import random
import re
from bisect import bisect_left

import pytest
import samples
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions.lcs import align
from reviewlake.operators import secrets, versions

PAIRS = "pair string, left string, right string"


def longest_common(a, b):
    """Length of the longest common subsequence, by the number of matches that can be chained."""
    ends = []  # ends[k]: smallest last column of a chain of k + 1 matches
    for x in a:
        for j in reversed([j for j, y in enumerate(b) if y == x]):
            k = bisect_left(ends, j)
            ends[k : k + 1] = [j]
    return len(ends)


def check(a, b):
    """What every alignment has to be, whichever way it was found."""
    rows = list(align(a, b))
    assert [i for _, i, _ in rows if i is not None] == list(range(len(a)))
    assert [j for _, _, j in rows if j is not None] == list(range(len(b)))
    assert all(same == (i is not None and j is not None and a[i] == b[j]) or not same for same, i, j in rows)
    assert sum(same for same, _, _ in rows) == longest_common(a, b)
    for (same, i, j), (then, p, q) in zip(rows, rows[1:]):
        if not same and not then:  # in a changed run the lines are paired from its start
            assert (i is not None or p is None) and (j is not None or q is None)
    return rows


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=16), st.lists(st.sampled_from("abcd"), max_size=16))
def test_alignment_is_longest_whole_and_paired(a, b):
    check(a, b)


@pytest.mark.parametrize(
    "a, b, rows",
    [
        # Where either line could stay, the one on the left does.
        ("xy", "yx", [(False, None, 0), (True, 0, 1), (False, 1, None)]),
        ("ab", "cb", [(False, 0, 0), (True, 1, 1)]),
        ("aab", "ba", [(False, None, 0), (True, 0, 1), (False, 1, None), (False, 2, None)]),
        ("abcd", "cdab", [(False, None, 0), (False, None, 1), (True, 0, 2), (True, 1, 3), (False, 2, None), (False, 3, None)]),
        ("", "ab", [(False, None, 0), (False, None, 1)]),
    ],
)
def test_ties_keep_the_left_line(a, b, rows):
    assert check(list(a), list(b)) == rows


def test_alignment_over_several_blocks():
    rng = random.Random(3)
    a = [str(rng.randrange(40)) for _ in range(300)]
    check(a, [x if rng.random() < 0.8 else "new" for x in a if rng.random() < 0.9])


def test_long_files_are_aligned_whole():
    a = [str(i) for i in range(20_000)]
    b = [x if i % 100 else "changed" for i, x in enumerate(a)] + ["end"]
    rows = list(align(a, b))
    assert sum(same for same, _, _ in rows) == 19_800 and len(rows) == 20_001


def test_sample_diff(spark):
    left, right = samples.original(), samples.fixed().replace("\n", "\r\n")
    df = spark.createDataFrame([("cart", left, right), ("same", left, left)], PAIRS)
    rows = versions.side_by_side(df, "pair").filter("pair = 'cart'").orderBy("pos").collect()
    assert len(rows) == 42
    assert [(r.left_no, r.right_no) for r in rows if r.kind == "changed"] == [
        (3, 3), (14, 14), (None, 18), (27, 28), (32, 33),
    ]
    assert rows[17].left is None and rows[17].right == "guard"
    stats = {r.pair: tuple(r)[1:] for r in versions.diff_stats(versions.side_by_side(df, "pair"), "pair").collect()}
    assert stats == {"cart": (37, 4, 0, 1), "same": (41, 0, 0, 0)}
    delta = {r.pair: tuple(r)[1:] for r in versions.line_delta(df, "pair").collect()}
    assert delta == {"cart": (37, 4, 5), "same": (41, 0, 0)}


def test_rows_rebuild_both_files(spark):
    rng = random.Random(5)
    texts = ["", "\n", "a", "a\n", "x\nx", "a\r\nb", "a\rb\n"]
    texts += ["\n".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(20)]
    pairs = [(f"{i}-{j}", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(pairs, PAIRS)
    # Counts alone are those of the rows, for equal pairs of other names too.
    again = df.union(df.limit(9).withColumn("pair", F.concat(F.lit("again "), "pair"))).union(df.limit(1).select("pair", F.lit(None).cast("string"), "right"))
    rows = {r.pair: tuple(r) for r in versions.diff_stats(versions.side_by_side(again, "pair"), "pair").collect()}
    assert {r.pair: tuple(r) for r in versions.pair_stats(again, "pair").collect()} == rows and len(rows) == len(pairs) + 9
    sides = {}
    for r in versions.side_by_side(df, "pair").orderBy("pair", "pos").collect():
        left, right = sides.setdefault(r.pair, ([], []))
        if r.left_no:
            left.append(r.left)
            assert len(left) == r.left_no
        if r.right_no:
            right.append(r.right)
            assert len(right) == r.right_no
    for pair, a, b in pairs:
        assert ["\n".join(s) for s in sides[pair]] == [a.replace("\r\n", "\n"), b.replace("\r\n", "\n")]


def test_line_delta_is_a_multiset_difference(spark):
    df = spark.createDataFrame([("p", "a\na\nb\n", "a\nc\na\na"), ("q", "", "")], PAIRS)
    rows = {r.pair: tuple(r)[1:] for r in versions.line_delta(df, "pair").collect()}
    assert rows == {"p": (2, 2, 2), "q": (1, 0, 0)}


def test_change_share(spark):
    df = spark.createDataFrame([("s", 3, 1, 0, 0), ("s", 0, 0, 1, 1), ("t", 1, 0, 0, 0)], "g string, same int, changed int, left_only int, right_only int")
    rows = {r.g: tuple(r)[1:] for r in versions.change_share(df, "g").collect()}
    assert rows == {"s": (6, 3, 500_000), "t": (1, 0, 0)}


def test_secrets(spark):
    text = "ok\nAPI-KEY = 1\nmy_token:x\npasswords = no\nbearer\n=\nSECRET\t= 2"
    df = spark.createDataFrame(
        [("src/a.ts", text), ("notes.md", text), (".env.example", text), ("sub/.env.example", "token=1"), ("bin", "\x00" + text), ("late", "x" * 9000 + "\x00\n" + text), ("clean", "x")],
        "path string, text string",
    )
    rows = sorted((r.path, r.line_no) for r in secrets.scan_secrets(df).collect())
    lines = [n for n, line in enumerate(text.split("\n"), 1) if re.search(secrets.SECRET_PATTERN, line)]
    assert lines == [2, 3, 7]
    assert rows == [("src/a.ts", n) for n in lines] + [("sub/.env.example", 1)]
