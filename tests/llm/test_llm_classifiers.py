"""Quality and toxicity: held-out accuracy, and rows of every kind."""

import random

import nasty
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import quality, toxicity, wordhash

SCHEMA = "doc_id long, quality int, toxic int"


def corpus(seed=0, n=500):
    """Prose of made-up words; a fifth is junk, another fifth holds one of a few bad stems."""
    rng = random.Random(seed)
    stems = ["badword", "grimble", "snarkel"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        junk, bad = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "ing"]))
        text = " ".join(w + rng.choice("&$#%*") * 3 if junk else w for w in words) + "."
        docs.append((i, text, rng.choice(["en", "de", None]), "s"))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    labels += [(0, None, None), (10**6, 1, 1), (None, 1, 1)]
    return nasty.documents(spark, docs + nasty.ROWS[1:4]), spark.createDataFrame(labels, SCHEMA), {i: (q, t) for i, q, t in labels[:500]}


def test_quality(spark, tables):
    docs, labels, truth = tables
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = {r.doc_id: r for r in rows if r.held_out and r.doc_id in truth and r.doc_id > 4}
    assert np.mean([r.predicted == truth[i][0] for i, r in held.items()]) > 0.95
    assert 0.7 < rows[0].prior < 0.9
    again = quality.classify(docs, labels).collect()
    assert sorted((str(r.doc_id), r.score) for r in rows) == sorted((str(r.doc_id), r.score) for r in again)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    good = sum(r.predicted for r in rows)
    assert kept.count() == good


def test_toxicity(spark, tables):
    docs, labels, truth = tables
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = {r.doc_id: r for r in rows if r.held_out and r.doc_id in truth and r.doc_id > 4}
    assert np.mean([r.predicted == truth[i][1] for i, r in held.items()]) > 0.9
    assert all(r.flagged == (r.score >= r.threshold) for r in rows)


def test_score_depends_on_the_text_alone(spark, tables):
    docs, labels, _ = tables
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a = {(str(r.doc_id), r.score) for r in toxicity.classify(docs, labels).collect()}
    assert a == {(str(r.doc_id), r.score) for r in toxicity.classify(moved, labels).collect()}


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_nothing_to_learn_from(spark, classify):
    none = spark.createDataFrame([], SCHEMA)
    rows = classify(nasty.documents(spark), none).collect()
    assert len(rows) == len(nasty.ROWS) and len({r.score for r in rows}) == 1
    assert classify(nasty.empty(spark), none).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], SCHEMA)
    assert classify(nasty.documents(spark), one).count() == len(nasty.ROWS)


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (900, 4))
    for prior in (0.3, 0.6, 0.9):
        mixed = np.where(rng.random((3000, 1)) < prior, rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (3000, 4)))
        assert abs(quality.estimated_prior(positive, mixed) - prior) < 0.08


def test_best_threshold():
    score, toxic = np.array([0.9, 0.8, 0.4, 0.2]), np.array([True, True, False, False])
    assert toxicity.best_threshold(score, toxic) == pytest.approx(0.6)
    assert toxicity.best_threshold(score, np.zeros(4, bool)) == toxicity.THRESHOLD


def test_word_hashes():
    """A hash depends on the bytes of a span alone, wherever it lies."""
    hasher = wordhash.Hasher()
    data, _ = wordhash.joined([b"one two one", b"two three", b""])
    start, end = wordhash.spans(~wordhash.SPACES[data])
    got = hasher.spans(hasher.sums(data), start, end)
    words = [bytes(data[a:b]) for a, b in zip(start, end)]
    assert words == [b"one", b"two", b"one", b"two", b"three"]
    assert got[0] == got[2] and got[1] == got[3] and len(set(got.tolist())) == 3


def test_every_labelled_text_is_learnt_from(spark):
    """Toxic texts count that come after the first 6000 by a hash of the id, and however the texts are cut into shards."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id")).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    order = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").collect()]
    late = set(order[6000:])
    words = random.Random(4)
    docs = [(i, " ".join(f"{words.choice('abcdefgh')}{words.choice('abcdefgh')}word" for _ in range(8)) + (" grimble" if i in late else ""), "en") for i in order]
    labels = spark.createDataFrame([(i, None, int(i in late)) for i in order], SCHEMA)
    df = spark.createDataFrame(docs + [(10**6, "abword grimble cdword", "en"), (10**6 + 1, "abword cdword", "en")], "doc_id long, text string, lang string")
    rows = toxicity._shards(df, labels)
    assert rows.count() == len(order) and rows.select("shard").distinct().count() == 2
    _, _, toxic, others = toxicity._document_counts(rows)
    assert (toxic, others) == (len(late), 6000)
    score = {r.doc_id: r.score for r in toxicity.classify(df, labels).collect() if r.doc_id >= 10**6}
    assert score[10**6] > 0.5 > score[10**6 + 1]


def test_slopes_are_those_of_the_loss():
    """Dense parameters and a word's embeddings, against differences of the loss."""
    rng = np.random.default_rng(1)
    net = toxicity.Cnn()
    for part in [*net.tables, *net.dense]:
        part += rng.normal(0, 0.3, part.shape).astype(np.float32)
    count, toxic = np.array([5, 0, 9]), np.array([1, 0, 0])
    ids = rng.integers(0, toxicity.BUCKETS, (14, len(toxicity.PREFIXES))).astype(np.uint16)

    def loss():
        p = net.scores(ids, count)
        return -np.mean(np.where(toxic == 1, np.log(p), np.log(1 - p)))

    def difference(part, at, step=1e-2):
        was, out = part[at], []
        for by in (step, -step):
            part[at] = was + by
            out.append(loss())
        part[at] = was
        return (out[0] - out[1]) / (2 * step)

    dense, words, slopes = net.slopes(ids, count, toxic, 3)
    for part, slope in zip(net.dense, dense):
        for at in list(np.ndindex(part.shape))[:: max(1, part.size // 9)]:
            assert difference(part, at) == pytest.approx(slope[at], abs=3e-3)
    total = np.zeros((14, toxicity.DIMENSIONS))
    np.add.at(total, words, slopes)
    for word in range(14):
        assert difference(net.tables[0], (ids[word, 0], 3)) == pytest.approx(total[word, 3], abs=3e-3)
