"""Repeats against all strings of all texts."""

import hashlib
import random

import nasty
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import repeats
from reviewlake.llm.common import table
from reviewlake.llm.queries import QUERIES


def brute(rows, least):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of every row, by a dictionary of all strings."""
    last = repeats.NO_ID
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, text in data:
        for at in range(len(text) - least + 1):
            s = text[at : at + least]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, text in data:
        gone = bytearray(len(text))
        for at in range(len(text) - least + 1):
            if first[text[at : at + least]] < i:
                gone[at : at + least] = b"\1" * least
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == last else i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def made(seed, n=60):
    """Texts of few letters with shared passages, copies and long runs of one letter."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé", k=rng.randint(30, 150))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        parts += rng.choices(passages, k=rng.randint(0, 3)) + ["x" * rng.choice([0, 0, 40, 130])]
        rng.shuffle(parts)
        rows.append((rng.choice([i, i, i // 2]), "".join(parts)))
    return rows + rng.choices(rows, k=8) + [(i + 100, t) for i, t in rng.choices(rows, k=8)] + [(None, rows[3][1]), (None, rows[3][1]), (5, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_equals_brute_force(spark, seed, monkeypatch):
    rows = made(seed)
    if seed == 2:
        monkeypatch.setattr(repeats, "MANY_CUTS", 3)
    if seed == 3:
        monkeypatch.setattr(repeats, "SEGMENT", 100)
        monkeypatch.setattr(repeats, "SUFFIXES", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(df, 50)) == brute(rows, 50)


def test_groups_are_the_longest_with_their_occurrences(spark):
    rows = [(i, t) for i, t in {i: t for i, t in made(5, 30) if i is not None}.items()]
    least = 50
    texts = {i: (t or "").encode() for i, t in rows}
    places = {}
    for i, text in texts.items():
        for at in range(len(text) - least + 1):
            places.setdefault(text[at : at + least], []).append((i, at))
    repeated = {min(found): sorted(found) for found in places.values() if len({i for i, _ in found}) > 1}
    want, begun = {}, {}
    for first, found in sorted(repeated.items()):
        # A string whose occurrences all follow those of the string before it makes that one's repeat longer.
        before = [(i, at - 1) for i, at in found]
        begin = begun[before[0]] if repeated.get(before[0]) == before else first
        begun[first] = begin
        want[begin] = (first[1] - begin[1] + least, repeated[begin])
    want = {(k, n): found for k, (n, found) in want.items()}
    assert len(want) > 10
    seen = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), least).collect():
        seen.setdefault(((r.group_doc, r.group_at), r.length), []).append((r.doc_id, r.at))
        assert r.occurrences >= 2
    assert {k: sorted(v) for k, v in seen.items()} == want


def test_stack_scan():
    common = repeats.np.array([0, 3, 5, 5, 2, 4, 0, 3])
    found = set(repeats.intervals(common, 3))
    assert found == {(5, 1, 3), (3, 0, 3), (4, 4, 5), (3, 6, 7)}


def test_nasty_rows(spark):
    rows = [(i, t) for i, t, _, _ in nasty.ROWS]
    short = [(i, t if t is None or len(t) < 1000 else None) for i, t in rows]
    want = {r[0]: r for r in brute(short, 50)}
    for r in got(repeats.remove_repeats(nasty.documents(spark))):
        if r[0] not in (5, 6, 10):
            assert r == want[r[0]]
    by = {r.doc_id: r for r in repeats.remove_repeats(nasty.documents(spark)).collect()}
    assert by[5].n_removed == 0 and by[10].n_removed == 0
    # Three spaces became line ends: strings over them are new, all others are in document 5.
    assert by[6].n_removed >= by[6].n_bytes - 150 and by[6].n_spans <= 4
    assert repeats.remove_repeats(nasty.empty(spark)).count() == 0
    assert repeats.repeat_groups(nasty.empty(spark)).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("no test tables here")
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    out = QUERIES["op11_repeats"](spark, sf)
    assert got(out) == brute(docs, 50)
    assert out.filter(F.col("n_removed") > 0).count() > 0


def lone(rng, phrases):
    """A text of phrases that other texts have too, but no longer string of theirs."""
    return "".join(rng.choice(phrases) + "".join(rng.choices("ghijklmnop", k=30)) for _ in range(40))


def test_only_strings_that_may_repeat_are_cut_out(spark):
    rng = random.Random(7)
    phrases = ["".join(rng.choices("abcdef", k=20)) for _ in range(5)]
    passage = "".join(rng.choices("qrstuv", k=70))
    rows = [(i, lone(rng, phrases)) for i in range(30)]
    rows[4], rows[9] = (4, rows[4][1] + passage), (9, passage + rows[9][1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cuts = repeats._settled_cuts(df.withColumn("text_key", F.xxhash64("text")), 50)
    # Only the passage's cuts are left, however many 16 bytes the texts share.
    assert {r.doc_id for r in cuts.select("doc_id").distinct().collect()} == {4, 9}
    assert cuts.count() <= 2 * 21
    assert got(repeats.remove_repeats(df, 50)) == brute(rows, 50)


def test_parts_of_a_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijklmnop", k=repeats.SEGMENT + 5000))
    border = repeats.SEGMENT
    rows = [(1, long), (2, long[border - 30 : border + 30] + "Z"), (3, "Z" + long[border - 60 : border]), (4, long[border - 60 : border + 1]), (5, long[-50:])]
    by = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert [by[i].n_removed for i in range(1, 6)] == [0, 60, 60, 61, 50]
    assert [by[i].n_spans for i in range(1, 6)] == [0, 1, 1, 1, 1]


def test_answers_are_a_bit_for_each_key():
    np = repeats.np
    parts, sizes = np.array([3, 3, 4, 5]), np.array([9, 2, 2, 1])
    low = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 8, 8, 8], np.uint32)
    some, ends, bits = repeats.compared(parts, sizes, low)
    assert some.tolist() == [True, True, True, False]
    assert ends.tolist() == [2, 3, 4]
    assert np.unpackbits(bits).tolist() == [0] * 8 + [1] + [0] * 7 + [1] + [0] * 7 + [1, 1] + [0] * 6
    keys = np.r_[parts[0].astype(np.uint64) << np.uint64(32) | low[:9], np.uint64(5 << 32 | 8)]
    assert repeats.told(keys, np.array([3]), [bits[:2].tobytes()]).tolist() == [3 << 32 | 8]
