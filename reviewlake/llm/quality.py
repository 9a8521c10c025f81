"""Operator 7: a quality classifier learnt from trusted positives and unlabelled text.

No text is taken as negative.  With the share of positives among unlabelled text (the class prior) known, the risk
of a classifier follows from positives and unlabelled texts alone; its estimate of the negatives' part is kept from
falling below zero, where it would fit noise.  The prior is estimated from a first classifier of positives against
unlabelled: the least ratio of their shares above a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import wordhash
from reviewlake.llm.common import bounded_batches, freeing, held_out, id_and_text, slices

# Bounds of the samples the model is fitted on; everything else covers all rows.
POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, BATCH = 24, 40, 256
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_CLASSES = np.zeros(256, np.uint8)  # other ASCII
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 1
_CLASSES[[32, 9, 11, 12]], _CLASSES[[10, 13]], _CLASSES[[46, 44, 59, 58, 63]] = 4, 5, 6
_KINDS = 7
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]



def features(texts: list[bytes], hasher: wordhash.Hasher) -> np.ndarray:
    """One row of shares and means per text, over all of it; an empty text has zeros but for the last, constant one."""
    n = len(texts)
    data, begin = wordhash.joined(texts)
    doc = np.repeat(np.arange(n), np.diff(begin))
    kind = _CLASSES[data]
    size = np.maximum(1.0, np.diff(begin) - 1.0)
    pairs = np.bincount(doc[1:] * _KINDS**2 + kind[:-1].astype(np.int64) * _KINDS + kind[1:], minlength=n * _KINDS**2)
    out = [np.sqrt(pairs.reshape(n, -1) / size[:, None])]
    slot = np.full(256, len(_SYMBOLS))
    slot[_SYMBOLS] = np.arange(len(_SYMBOLS))
    symbols = np.bincount(doc * (len(_SYMBOLS) + 1) + slot[data], minlength=n * (len(_SYMBOLS) + 1))
    out.append(np.sqrt(symbols.reshape(n, -1)[:, :-1] / size[:, None]))
    start, end = wordhash.spans(~wordhash.SPACES[data])
    of = doc[start]
    words = np.bincount(of, minlength=n)
    least = np.maximum(1, words)
    length = (end - start).astype(float)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    ups, alphas = upper[end] - upper[start], letters[end] - letters[start]
    hashes = hasher.spans(hasher.sums(wordhash.LOWER[data]), start, end)
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], new, n)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(order)))
    most = np.zeros(n)
    np.maximum.at(most, of[order][first], runs)
    again = np.zeros(len(start))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    mean = np.bincount(of, length, n) / least
    spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / least - mean**2))
    columns = [
        mean / 10, spread / 10, distinct / least, most / least, np.bincount(of, again, n) / least,
        np.bincount(of, (ups == alphas) & (alphas > 1), n) / least, np.bincount(of, ups == 1, n) / least,
        np.bincount(of, alphas == 0, n) / least, np.bincount(of, alphas < length - 1, n) / least,
        np.log1p(words) / 10, distinct / np.sqrt(least) / 30, (words > 0).astype(float), np.ones(n),
    ]
    out.append(np.stack(columns, axis=1))
    return np.concatenate(out, axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Net:
    """One hidden layer; standardised inputs."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        self.w = random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden))
        self.b, self.v, self.c = np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)
        self._moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.b, self.v, self.c)]
        self._steps = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w + self.b) @ self.v + self.c[0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = 5e-3, decay: float = 1e-3) -> None:
        """One step of Adam against the slope of the risk in each row's score."""
        x = self.inputs(x)
        h = np.tanh(x @ self.w + self.b)
        back = np.outer(slope, self.v) * (1 - h**2)
        slopes = (x.T @ back + decay * self.w, back.sum(0), h.T @ slope + decay * self.v, slope.sum(keepdims=True))
        self._steps += 1
        for p, g, (m, s) in zip((self.w, self.b, self.v, self.c), slopes, self._moments):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**self._steps)) / (np.sqrt(s / (1 - 0.999**self._steps)) + 1e-8)


def _batches(n_p: int, n_u: int, epochs: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        u = random.permutation(n_u)
        for at in range(0, n_u, BATCH):
            yield random.integers(0, n_p, min(BATCH, 2 * n_p)), u[at : at + BATCH]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Share of positives among unlabelled rows.

    A classifier is fitted on two thirds of both; on the rest, the share of unlabelled over that of positive rows
    above any score is at least the prior, and nearest to it where negatives are rarest.
    """
    p_rest, u_rest = np.arange(len(positive)) % 3 == 0, np.arange(len(unlabelled)) % 3 == 0
    p, u = positive[~p_rest], unlabelled[~u_rest]
    if not len(p) or not len(u) or not p_rest.any() or not u_rest.any():
        return 0.5
    net = Net(np.concatenate([p, u]), HIDDEN, seed)
    for a, b in _batches(len(p), len(u), EPOCHS // 2, seed):
        x = np.concatenate([p[a], u[b]])
        y = np.concatenate([np.ones(len(a)), np.zeros(len(b))])
        weight = np.concatenate([np.full(len(a), 0.5 / len(a)), np.full(len(b), 0.5 / len(b))])
        net.step(x, (_sigmoid(net.scores(x)) - y) * weight)
    p_score, u_score = np.sort(net.scores(positive[p_rest])), np.sort(net.scores(unlabelled[u_rest]))
    at = np.unique(p_score)
    p_above = 1 - np.searchsorted(p_score, at) / len(p_score)
    u_above = 1 - np.searchsorted(u_score, at) / len(u_score)
    slack = np.sqrt(np.log(40) / 2 / len(p_score)) + np.sqrt(np.log(40) / 2 / len(u_score))
    best = np.argmin((u_above + slack) / p_above)
    return float(np.clip(u_above[best] / p_above[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Net | None:
    """Minimise the non-negative unbiased risk with the logistic loss; None without rows to learn from."""
    if not len(positive) or not len(unlabelled):
        return None
    net = Net(np.concatenate([positive, unlabelled]), HIDDEN, seed)
    for a, b in _batches(len(positive), len(unlabelled), EPOCHS, seed + 1):
        x = np.concatenate([positive[a], unlabelled[b]])
        score = net.scores(x)
        on_p, on_u = score[: len(a)], score[len(a) :]
        # Loss of calling a row negative: log(1 + e^score); of calling it positive: log(1 + e^-score).
        negative = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
        slope_p, slope_u = np.zeros(len(a)), np.zeros(len(b))
        if negative >= 0:
            slope_p += prior * (_sigmoid(on_p) - 1) / len(a) - prior * _sigmoid(on_p) / len(a)
            slope_u += _sigmoid(on_u) / len(b)
        else:  # walk back up on the negatives' part only
            slope_p += prior * _sigmoid(on_p) / len(a)
            slope_u -= _sigmoid(on_u) / len(b)
        net.step(x, np.concatenate([slope_p, slope_u]))
    return net


def _sample(docs: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Texts of the `most` ids that come first by a hash of the id; one text for each id."""
    place = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    picked = keys.filter("doc_id IS NOT NULL").distinct().orderBy(place, "doc_id").limit(most)
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))


def _featured(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wordhash.Hasher()
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                x = features(texts, hasher)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), flat], names=["doc_id", "x"])

    rows = docs.mapInArrow(freeing(run), "doc_id long, x array<float>").toPandas().sort_values("doc_id")
    return np.stack(rows.x.to_list()).astype(np.float64) if len(rows) else np.zeros((0, 1))


def learn(docs: DataFrame, trusted: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(net, prior) from the ids of trusted positives and all of docs as unlabelled text, both sampled by a hash."""
    good = _featured(_sample(docs, trusted.select("doc_id"), positives))
    some = _featured(_sample(docs, docs.select("doc_id"), unlabelled))
    prior = estimated_prior(good, some)
    return fit(good, some, prior), prior


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score of every row's whole text, a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wordhash.Hasher()
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                found = np.full(len(texts), 0.5) if net is None else _sigmoid(net.scores(features(texts, hasher)))
                keys = batch.column("doc_id").slice(first, len(texts))
                yield pa.record_batch([keys, pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(freeing(run), "doc_id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, id_col="doc_id", text_col="text"
) -> DataFrame:
    """doc_id, held_out, score, predicted, prior of every row.

    Labels of held-out ids (crc32 of the id modulo `folds` is `fold`) are never learnt from, nor are their texts.  The score
    depends on the text alone.  NULL texts are empty and scored like any other; a NULL id counts as empty text for
    the fold; labels that are NULL are not used; without positives or documents every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    out = held_out(F.col("doc_id"), folds, fold)
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter(~out)
    net, prior = learn(rows.filter(~out), trusted)
    scored = score(rows, net)
    return scored.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.lit(prior).alias("prior")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; learnt as in classify().

    Texts are scored and rows dropped in one map, without a join.
    """
    bounded_batches(docs.sparkSession)
    out = held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter(~out)
    net, _ = learn(id_and_text(docs, id_col, text_col).filter(~out), trusted)
    text = [f.name for f in docs.schema].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = wordhash.Hasher()
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(text), "").cast(pa.binary())
            for first, part in slices(texts):
                keep = np.full(len(part), True) if net is None else _sigmoid(net.scores(features(part, hasher))) >= threshold
                yield batch.slice(first, len(part)).filter(pa.array(keep))

    return docs.mapInArrow(freeing(run), docs.schema)
