"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import os

import pytest

from reviewlake.llm.common import settle, table
from reviewlake.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(r) for r in cursor.fetchall()), key=repr)


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF_DIR))
        kept[name] = docs
        if name != "encode":
            assert docs.columns == columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert docs.exceptAll(before).count() == 0
    scored = QUERIES["op7_quality"](spark, SF_DIR).filter("predicted = 1")
    assert kept["quality"].count() == scored.count()
    texts = [r.text for r in kept["quality"].collect()]
    assert kept["exact_dedup"].count() == len({" ".join((t or "").encode().decode().split()) for t in texts})
    left = {r.doc_id: shingles(r.text) for r in kept["near_dedup"].collect()}
    gone = [r for r in kept["exact_dedup"].collect() if r.doc_id not in left]

    def alike(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    keys = sorted(left)
    assert not any(alike(left[a], left[b]) for i, a in enumerate(keys) for b in keys[:i])
    everything = [(r.doc_id, shingles(r.text)) for r in kept["exact_dedup"].collect()]
    assert all(any(i != r.doc_id and alike(shingles(r.text), s) for i, s in everything) for r in gone)
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = sorted(tuple(r.ids) for r in docs.collect())
    mixed = [r.text for r in kept["mixing"].collect()]
    assert ids == sorted(tuple(e.ids) for e in library.encode_batch(mixed, add_special_tokens=False))
    copies = {}
    for r in kept["mixing"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(left) and max(copies.values()) <= 2
