"""Operator 8: a convolutional text classifier for toxicity, trained on all labelled texts side by side.

A word is the sum of hashed embeddings: of the whole word and of its first 4, 5 and 6 bytes, so that inflected
forms share some.  Filters of several widths slide over the words, each keeps its largest answer over the whole text,
and a linear layer makes the score.  One embedding dimension begins at the smoothed log-odds of its bucket
over all documents to learn from; all are trained on.  In each epoch every shard of the documents trains the network as the
last epoch left it, and what the shards have changed is averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import wordhash
from reviewlake.llm.common import bounded_batches, forget, freeing, held_out, matching, settle, slices, swept

# Texts of a shard, and how many shards there are at the most; beyond, shards grow.
PER_SHARD, SHARDS = 4000, 64
# Texts are put in another order in runs of so many, and of so many words.
RUN, RUN_WORDS = 1024, 1 << 20
# Words whose slopes are computed at once.
SLICE_WORDS = 1 << 17
# Changes are averaged as whole multiples of this, so that their sums do not depend on an order.
UNIT = 2.0**-20
PREFIXES = (None, 4, 5, 6)
BUCKETS, DIMENSIONS = 1 << 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH = 6, 64
THRESHOLD = 0.3
# Texts with this remainder set the thresholds, the others the network; scores are counted in so many steps.
FIT_FOLDS, STEPS = 5, 10_000
FOLDS, HELD_OUT = 4, 2

# A word is a run of ASCII letters and bytes beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[65:91] = _LETTERS[128:] = True


def word_ids(texts: list[bytes], hasher: wordhash.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word in each table, number of words of each text)."""
    data, begin = wordhash.joined(texts)
    start, end = wordhash.spans(_LETTERS[data])
    sums = hasher.sums(wordhash.LOWER[data])
    ids = np.empty((len(start), len(PREFIXES)), np.uint16)
    for i, size in enumerate(PREFIXES):
        cut = end if size is None else np.minimum(end, start + size)
        ids[:, i] = (hasher.spans(sums, start, cut) + np.uint64(i)) >> np.uint64(48)
    count = np.diff(np.searchsorted(start, begin))
    return ids, count


class Cnn:
    def __init__(self, seed: int = 0):
        random = np.random.default_rng(seed)
        self.tables = [random.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32) for _ in PREFIXES]
        self.filters = [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # the first filter of each width begins as the mean log-odds of its words
            f[:, :, 0] = 0
            f[:, 0, 0] = 1 / len(f)
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out[::FILTERS] = 0.5
        self.level = np.full(1, -3, np.float32)

    @classmethod
    def of(cls, arrays: dict) -> Cnn:
        net = cls.__new__(cls)
        vars(net).update(arrays)
        return net

    def begin_at_log_odds(self, with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> None:
        """Dimension 0 of each bucket (table, bucket): log-odds of its document counts, shrunk where documents are few."""
        odds = np.log((with_1 + 0.5) / (n1 + 1)) - np.log((with_0 + 0.5) / (n0 + 1))
        seen = with_1 + with_0
        for table, begin in zip(self.tables, odds * seen / (seen + 4) / len(PREFIXES)):
            table[:, 0] = begin

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.level]

    def embedded(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts, and blank ones behind each text so that no filter sees two texts at once."""
        pad = max(WIDTHS) - 1
        begin = np.concatenate([[0], np.cumsum(count + pad)])
        place = np.arange(len(ids)) + pad * np.repeat(np.arange(len(count)), count)
        x = np.zeros((begin[-1] + pad, DIMENSIONS), np.float32)
        total = self.tables[0][ids[:, 0]]
        for i in range(1, len(PREFIXES)):
            total += self.tables[i][ids[:, i]]
        x[place] = total
        return x, begin

    def pooled(self, x: np.ndarray, begin: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter in each text, not below zero; and all answers."""
        n, out, answers = begin[-1], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            y = x[:n] @ f[0] + b
            for j in range(1, w):
                y += x[j : n + j] @ f[j]
            y[blank] = 0
            answers.append(y)
            out.append(np.maximum(np.maximum.reduceat(y, begin[:-1], axis=0), 0))
        return np.concatenate(out, axis=1), answers

    @staticmethod
    def blanks(begin: np.ndarray) -> np.ndarray:
        pad = max(WIDTHS) - 1
        return (begin[1:, None] - 1 - np.arange(pad)).ravel()

    def scores(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        x, begin = self.embedded(ids, count)
        pool, _ = self.pooled(x, begin, self.blanks(begin))
        return 1 / (1 + np.exp(-np.clip(pool @ self.out + self.level[0], -30, 30).astype(np.float64)))

    def slopes(self, ids: np.ndarray, count: np.ndarray, toxic: np.ndarray, docs: int) -> tuple:
        """Slopes of the loss, a mean over `docs` texts of which these are some: of the dense parameters, and of words.

        The latter are rows of `ids` and the slope in the sum of a word's embeddings.
        """
        x, begin = self.embedded(ids, count)
        pool, answers = self.pooled(x, begin, self.blanks(begin))
        p = 1 / (1 + np.exp(-np.clip(pool @ self.out + self.level[0], -30, 30)))
        slope = ((p - toxic) / docs).astype(np.float32)
        back = np.outer(slope, self.out) * (pool > 0)
        first = np.cumsum(count) - count
        filters, words, parts = [], [], []
        for i, (f, y) in enumerate(zip(self.filters, answers)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            best = np.repeat(begin[:-1, None], FILTERS, axis=1)
            for d in np.flatnonzero(g.any(1)):
                best[d] += y[begin[d] : begin[d + 1]].argmax(0)
            filters.append(np.zeros_like(f))
            for j in range(len(f)):
                filters[-1][j] = np.einsum("dfk,df->kf", x[best + j], g)
                # Places behind the last word of a text are blank.
                place = best + j - begin[:-1, None]
                real = (place < count[:, None]) & (g != 0)
                words.append((first[:, None] + place)[real])
                parts.append((g[:, :, None] * f[j].T)[real])
        bias = [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
        dense = [*filters, *bias, pool.T @ slope, slope.sum(keepdims=True)]
        return dense, np.concatenate(words), np.concatenate(parts)

    def train(self, ids: list[np.ndarray], toxic: np.ndarray, moments: list, steps: int, seed: list[int]) -> int:
        """Steps over texts in a drawn order, in batches; `moments` are those of Adam.  The number of steps so far."""
        order = np.random.default_rng(seed).permutation(len(ids))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            count = np.array([len(ids[d]) for d in docs])
            # Long texts do not meet in one slice.
            slice_of = (np.cumsum(count) - 1) // SLICE_WORDS
            total, found = None, []
            for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(slice_of)) + 1):
                own = np.concatenate([ids[d] for d in docs[part]])
                dense, words, slopes = self.slopes(own, count[part], toxic[docs[part]], len(docs))
                total = dense if total is None else [a + b for a, b in zip(total, dense)]
                found.append((own[words], slopes))
            for i, table in enumerate(self.tables):
                bucket, slopes = np.concatenate([w[:, i] for w, _ in found]), np.concatenate([g for _, g in found])
                if len(bucket):
                    sort = np.argsort(bucket, kind="stable")
                    bucket = bucket[sort]
                    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                    table[bucket[first]] -= np.float32(0.5) * np.add.reduceat(slopes[sort], first)
            steps += 1
            total[-2] = total[-2] + 1e-4 * self.out
            for q, g, (m, s) in zip(self.dense, total, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                q -= 0.02 * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
        return steps

    def copy(self) -> Cnn:
        return Cnn.of({k: [p.copy() for p in v] if isinstance(v, list) else v.copy() for k, v in vars(self).items()})

    def flat(self) -> np.ndarray:
        """All parameters as rows of DIMENSIONS numbers: the buckets of each table, then the dense ones."""
        dense = np.concatenate([p.ravel() for p in self.dense])
        return np.concatenate([*self.tables, np.pad(dense, (0, -len(dense) % DIMENSIONS)).reshape(-1, DIMENSIONS)])

    def change(self, cells: np.ndarray, by: np.ndarray) -> None:
        rows = self.flat()
        rows[cells] += by.astype(np.float32)
        for i, table in enumerate(self.tables):
            table[:] = rows[i * BUCKETS : (i + 1) * BUCKETS]
        rest, at = rows[len(PREFIXES) * BUCKETS :].ravel(), 0
        for p in self.dense:
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size


def best_threshold(
    score: np.ndarray, toxic: np.ndarray, default: float = THRESHOLD, rows: np.ndarray | None = None, least: np.ndarray | None = None
) -> float:
    """The threshold of the best F1, in the middle between the two scores it parts; the default without both classes.

    Rows of near scores may come as one: `rows` of them, `toxic` of these, with their highest score and their least.
    """
    rows, least = np.ones(len(score)) if rows is None else rows, score if least is None else least
    if not toxic.any() or toxic.sum() == rows.sum():
        return default
    order = np.argsort(-score, kind="stable")
    f1 = 2 * np.cumsum(toxic[order]) / (np.cumsum(rows[order]) + toxic.sum())
    k = int(np.argmax(f1))
    below = score[order][k + 1] if k + 1 < len(order) else 0.0
    return float((least[order][k] + below) / 2)


def _shards(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fits, shard, toxic, lang, ids (buckets of all words) of every labelled row, a shard in one file and in order, as a written table."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = settle(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    shards = max(1, min(SHARDS, math.ceil(known.count() / PER_SHARD)))
    drawn = lambda what, n: F.pmod(F.xxhash64("doc_id", F.lit(what)), F.lit(n)).cast("int")
    rows = matching(docs.filter("doc_id IS NOT NULL"), known, "doc_id", "inner").select(
        (drawn("fold", FIT_FOLDS) != 0).alias("fits"), drawn("shard", shards).alias("shard"), F.xxhash64("doc_id", F.lit("place")).alias("place"),
        (F.col("toxic") == 1).cast("int").alias("toxic"), "lang", "text",
    )
    # More partitions than shards, so that few shards share one.
    rows = rows.repartition(4 * shards, "shard").sortWithinPartitions("shard", "place", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names = wordhash.Hasher(), ["fits", "shard", "toxic", "lang"]
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                ids, count = word_ids(texts, hasher)
                packed = [p.tobytes() for p in np.split(ids, np.cumsum(count)[:-1])]
                others = [batch.column(c).slice(first, len(texts)) for c in names]
                yield pa.record_batch([*others, pa.array(packed, pa.binary())], names=[*names, "ids"])

    out = settle(rows.mapInArrow(freeing(run), "fits boolean, shard int, toxic int, lang string, ids binary"), codec="zstd")
    forget(known)
    return out


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint16).reshape(-1, len(PREFIXES)) for p in batch.column("ids").to_pylist()]


def _document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many toxic and other documents each bucket of each table is, and how many of both there are."""
    cells = len(PREFIXES) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells + 1), np.int64)  # the last cell counts documents
        for batch in batches:
            for ids, toxic in zip(_unpacked(batch), batch.column("toxic").to_pylist()):
                for i in range(len(PREFIXES)):
                    total[toxic, i * BUCKETS + np.unique(ids[:, i]).astype(np.int64)] += 1
                total[toxic, cells] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], names=["cell", "n1", "n0"])

    found = rows.select("toxic", "ids").mapInArrow(freeing(run), "cell long, n1 long, n0 long")
    found = found.groupBy("cell").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()  # of fixed size
    total = np.zeros((2, cells + 1), np.int64)
    total[1, found.cell], total[0, found.cell] = found.n1, found.n0
    with_0, with_1 = total[:, :cells].reshape(2, len(PREFIXES), BUCKETS)
    return with_1, with_0, int(total[1, cells]), int(total[0, cells])


def _epoch(rows: DataFrame, net: Cnn, epoch: int) -> None:
    """All rows train copies of the network, one in each shard; their changes, averaged, are made in `net`."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(net))
    values = [f"d{k}" for k in range(DIMENSIONS)]

    def changes(base: np.ndarray, own: Cnn, docs: int) -> pa.RecordBatch:
        by = np.rint((own.flat() - base) / UNIT)
        at = np.flatnonzero(by.any(1) | (np.arange(len(by)) >= len(PREFIXES) * BUCKETS))
        columns = [pa.array(c) for c in np.ascontiguousarray(by[at].astype(np.int32).T)]
        return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), docs, np.int32)), *columns], names=["cell", "docs", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = Cnn.of(shared.value)
        base = start.flat()
        now, own, moments, steps, docs, turn = None, None, [], 0, 0, 0
        ids, toxic, words = [], [], 0

        def train() -> None:
            nonlocal steps, docs, turn, words
            steps = own.train(ids, np.array(toxic), moments, steps, [epoch, now, turn])
            docs, turn, words = docs + len(ids), turn + 1, 0
            ids.clear()
            toxic.clear()

        for batch in batches:
            for shard, text, label in zip(batch.column("shard").to_pylist(), _unpacked(batch), batch.column("toxic").to_pylist()):
                if shard != now:
                    if ids:
                        train()
                    if own:
                        yield changes(base, own, docs)
                    now, own, steps, docs, turn = shard, start.copy(), 0, 0, 0
                    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in own.dense]
                ids.append(text)
                toxic.append(label)
                words += len(text)
                if len(ids) == RUN or words >= RUN_WORDS:
                    train()
        if ids:
            train()
        if own:
            yield changes(base, own, docs)

    schema = ", ".join(["cell int", "docs int", *(f"{v} int" for v in values)])
    found = rows.select("shard", "toxic", "ids").mapInArrow(freeing(run), schema)
    # A bucket's change is averaged over the shards in which it has one.
    sums = [F.sum(F.col(v).cast("long") * F.col("docs")).alias(v) for v in values]
    found = found.groupBy("cell").agg(F.sum("docs").alias("docs"), *sums).toPandas()  # of fixed size, as the network
    net.change(found.cell.to_numpy(), found[values].to_numpy() * UNIT / found.docs.to_numpy()[:, None])
    shared.unpersist()


def _thresholds(rows: DataFrame, net: Cnn) -> DataFrame:
    """lang, threshold: the best one of each language over all rows, whose scores are counted in steps."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn.of(shared.value)
        for batch in batches:
            for first in range(0, len(batch), BATCH):
                part = batch.slice(first, BATCH)
                ids = _unpacked(part)
                score = pa.array(own.scores(np.concatenate(ids), np.array([len(p) for p in ids])), pa.float64())
                yield pa.record_batch([part.column("lang"), part.column("toxic"), score], names=["lang", "toxic", "score"])

    def best(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
        found = best_threshold(steps.high.to_numpy(), steps.toxic.to_numpy(), rows=steps.n.to_numpy(), least=steps.low.to_numpy())
        return pd.DataFrame({"lang": [key[0]], "threshold": [found]})

    scored = rows.select("lang", "toxic", "ids").mapInArrow(freeing(run), "lang string, toxic int, score double")
    steps = scored.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.sum("toxic").alias("toxic"), F.count("*").alias("n")
    )
    # A language has no more rows than there are steps.
    return settle(steps.groupBy("lang").applyInPandas(best, "lang string, threshold double"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Cnn | None, DataFrame | None]:
    """(network, threshold by language) from all labelled rows and their whole texts; a fifth of them only sets thresholds."""
    rows = _shards(docs, labels)
    if not rows.head(1):
        return None, None
    fits = rows.filter("fits")
    net = Cnn()
    with_1, with_0, n1, n0 = _document_counts(fits)
    if n1 and n0:
        net.begin_at_log_odds(with_1, with_0, n1, n0)
        for epoch in range(EPOCHS):
            _epoch(fits, net, epoch)
            swept(docs.sparkSession)
    else:
        net.out[:], net.level[:] = 0, 3 if n1 else -3
    thresholds = _thresholds(rows.filter("NOT fits"), net)
    forget(rows)
    return net, thresholds


def score(docs: DataFrame, net: Cnn | None) -> DataFrame:
    """doc_id, lang, score of every row's whole text, a map without a shuffle; lang only passes through."""
    # The network has a fixed size: 4 tables of 2**16 buckets, 8 MB.
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = wordhash.Hasher(), None if shared.value is None else Cnn.of(shared.value)
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                found = np.zeros(len(texts)) if own is None else own.scores(*word_ids(texts, hasher))
                others = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "lang")]
                yield pa.record_batch([*others, pa.array(found, pa.float64())], names=["doc_id", "lang", "score"])

    return docs.mapInArrow(freeing(run), "doc_id long, lang string, score double")


def classify(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, id_col="doc_id", text_col="text", lang_col="lang"
) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged of every row.

    All labelled rows are learnt from but those of held-out ids (crc32 of the id modulo `folds` is `fold`).  The score depends
    on the text alone; `flagged` compares it with the threshold of the row's language, `predicted` with 0.3.  NULL texts are
    empty and scored like any other; NULL labels are not used; without labels of both classes scores are constant.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
    )
    out = held_out(F.col("doc_id"), folds, fold)
    net, thresholds = learn(rows.filter(~out), labels.filter(~held_out(F.col("doc_id").cast("long"), folds, fold)))
    scored = score(rows, net)
    if thresholds is None:
        scored = scored.withColumn("threshold", F.lit(THRESHOLD))
    else:
        scored = matching(scored, thresholds, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(THRESHOLD)))
    return scored.select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("flagged"),
    )
