"""Exact duplicates against a plain grouping of normalised texts."""

import hashlib
import random
import re

import nasty
import pytest

from reviewlake.llm import exact


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(norm(text), []).append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for k in sorted(keys, key=lambda k: (k is None, k)):
            out.append((str(k), str(keep), len(keys), first, sha))
            first = False
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_nasty_rows(spark):
    assert found(exact.deduplicate(nasty.documents(spark))) == brute([(i, t) for i, t, _, _ in nasty.ROWS])
    assert exact.deduplicate(nasty.empty(spark)).count() == 0
    kept = exact.distinct(nasty.documents(spark))
    assert kept.columns == nasty.documents(spark).columns
    assert kept.count() == len({norm(t) for _, t, _, _ in nasty.ROWS})


@pytest.mark.parametrize("size", [3, 8192])
def test_many_copies_over_many_blocks(spark, size):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot hot hot hot") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(exact.deduplicate(df, size)) == brute(rows)


def test_normalised():
    assert [exact.normalised(t) for t in (b"", b" \n", b"a", b"\ta  b\x0b", b"a\r\n b")] == [b"", b" ", b"a", b" a b ", b"a b"]


def test_contents_of_one_short_key(spark, monkeypatch):
    """If the hash of the short key told nothing, names would still be those of whole contents."""
    monkeypatch.setattr(exact, "HEAD", 1)
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(7).cast("long"))
    rows = [(i, f"a{i % 17} same beginning") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(exact.deduplicate(df, 8)) == brute(rows)
