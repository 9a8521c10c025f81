"""Operator 12: ranked lexical search by sequential reads of impact-sorted lists without random access (NRA).

Documents are indexed where they lie: a task takes its documents in blocks, and a block has a list per term, highest
impact first.  An item's lists are read from the top, side by side.  What has been read of a document bounds its score
from below; with the last impact read from every list that has not shown it, from above.  Documents whose upper
bound falls under the k-th lower bound leave; reading goes on until no unseen document can enter, no tie is open and
the scores of all that remain are known.  A task keeps its best k of each item, and these meet in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlake.llm.common import bounded_batches, forget, freeing, id_and_text, settle, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Items that are searched together: their terms go to every task.
ITEMS, ITEM_BYTES = 1000, 8 << 20
# A block ends at so many entries of its lists, or documents.
ENTRIES, DOCUMENTS = 2_000_000, 100_000
FIRST_READ = 128
# The best of all tasks meet in so many parts of an item first.
PARTS = 64
NO_ID = (1 << 63) - 1


def _table() -> bytes:
    """Bytes of terms as they are, A-Z in lower case; every other byte is a space."""
    out = bytearray(b" " * 256)
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            out[c] = c + 32 if 65 <= c <= 90 else c
    return bytes(out)


_BYTES = _table()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term weighs in a document by its occurrences there and the document's length."""
    m = 100 - 75 + 75 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and exact scores of all that may be among the best k, from lists of (document, score) sorted by score.

    Documents are numbers below size; those that surely stay below `floor` or the k-th best are left out.  Ties stay.
    """
    lists = [x for x in lists if len(x[0]) and x[1][0] > 0]
    lower = np.zeros(size, np.int64)
    shown = np.zeros((len(lists), size), bool)
    alive: np.ndarray | None = None  # all that can still enter, once nothing unseen can
    at, step = 0, FIRST_READ
    least = max(floor, 1)
    while True:
        frontier = np.zeros(len(lists), np.int64)
        for i, (docs, scores) in enumerate(lists):
            if at < len(docs):
                read = slice(at, at + step)
                seen, more = docs[read], scores[read]
                lower[seen] += more
                shown[i, seen] = True
                if at + step < len(docs):
                    # Nothing further down the list scores more than what is read last.
                    frontier[i] = scores[at + step - 1]
        at, step = at + step, step * 4
        rest = int(frontier.sum())
        candidates = np.flatnonzero(lower) if alive is None else alive
        known = lower[candidates]
        if len(known) > k:
            least = max(least, int(np.partition(known, len(known) - k)[len(known) - k]))
        candidates = candidates[known + rest >= least]
        if rest:
            upper = lower[candidates] + rest - frontier @ shown[:, candidates]
            candidates, upper = candidates[upper >= least], upper[upper >= least]
            resolved = bool((upper == lower[candidates]).all())
        else:
            resolved = True
        if rest < least:
            alive = candidates
            if resolved:
                found = candidates[lower[candidates] >= least]
                return found, lower[found]


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n (terms of the whole text), term and tf (of those in the vocabulary) of every document with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                ids = batch.column("doc_id").slice(first, len(texts))
                sizes, found = [], []
                for text in texts:
                    words = terms(text)
                    sizes.append(len(words))
                    count = Counter(map(number, words))
                    count.pop(None, None)
                    found.append(count)
                ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
                lists = [pa.array([x for c in found for x in f(c)], pa.int32()) for f in (Counter.keys, Counter.values)]
                columns = [ids, pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists)]
                yield pa.record_batch(columns, names=["doc_id", "n", "term", "tf"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(freeing(run), "doc_id long, n long, term array<int>, tf array<int>").filter("n > 0")


def _searched(index: DataFrame, items: list[Counter], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item (its number), doc_id, score: the best k of each item in each task."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def block(batches: list[pa.RecordBatch], best: list) -> None:
        rows = pa.Table.from_batches(batches)
        ids = np.asarray(rows.column("doc_id").fill_null(NO_ID))
        n = np.asarray(rows.column("n"))
        sizes = np.concatenate([np.asarray(pa.compute.list_value_length(b.column("term"))) for b in batches])
        term, tf = (np.concatenate([np.asarray(b.column(c).flatten()) for b in batches]) for c in ("term", "tf"))
        doc = np.repeat(np.arange(len(ids)), sizes)
        score = impact(tf.astype(np.int64), n[doc], documents, length)
        order = np.lexsort((-score, term))
        doc, score, term = doc[order], score[order], term[order]
        items, weights = shared.value
        ends = np.searchsorted(term, np.arange(len(weights) + 1))
        for number, item in enumerate(items):
            lists = [
                (doc[ends[t] : ends[t + 1]], score[ends[t] : ends[t + 1]] * (weights[t] * count)) for t, count in item.items()
            ]
            held_ids, held = best[number]
            floor = int(held.min()) if len(held) == k else 0
            found, exact = nra(lists, len(ids), k, floor)
            both, scores = np.r_[held_ids, ids[found]], np.r_[held, exact]
            first = best_first(both, scores, k)
            best[number] = (both[first], scores[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in shared.value[0]]
        waiting, entries, rows = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            entries += len(batch.column("term").flatten())
            rows += batch.num_rows
            if entries >= ENTRIES or rows >= DOCUMENTS:
                block(waiting, best)
                waiting, entries, rows = [], 0, 0
        if rows:
            block(waiting, best)
        number = np.repeat(np.arange(len(best)), [len(ids) for ids, _ in best])
        if len(number):
            columns = [number, np.concatenate([ids for ids, _ in best]), np.concatenate([s for _, s in best])]
            yield pa.record_batch([pa.array(c) for c in columns], names=["item", "doc_id", "score"])

    return index.mapInArrow(freeing(run), "item long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col="doc_id", text_col="text", item_col="item_id", query_col="text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each row of items.

    Terms are compared whole, with A-Z in lower case, counts and lengths are over all documents.  Equal scores rank by
    doc_id, NULL last.  NULL and empty texts and texts without terms have none: such documents are not counted and such
    items get no rows.  Each of repeated rows is a document or an item of its own.  Without documents there are no rows.
    Items are searched in groups of at most ITEMS rows or, but for one long item, about ITEM_BYTES of text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(items[item_col].alias("item_id"), F.coalesce(items[query_col].cast("string"), F.lit("")).alias("text"))
    asked = settle(asked.withColumn("group", F.lit(0)))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    dealt = asked if groups == 1 else settle(asked.withColumn("group", F.pmod(F.xxhash64("text", "item_id"), F.lit(groups)).cast("int")))
    out = None
    for group in range(groups):
        rows = dealt.filter(F.col("group") == group).collect()  # a bounded part of the items
        counts = [Counter(terms(r.text.encode())) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        index = settle(indexed(docs, vocabulary, id_col, text_col))
        totals = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # terms of the items only
            df[r.term] = r["count"]
        weights = np.array([weight(int(d), totals.documents) for d in df], np.int64)
        numbered = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in counts]
        found = _searched(index, numbered, weights, totals.documents, max(1, totals.length), k)
        order = [F.desc("score"), F.asc("doc_id")]
        part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
        best = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k).drop("rank")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        kind = dealt.schema["item_id"].dataType
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
        best = settle(best.join(F.broadcast(names), "item"))  # at most ITEMS names
        forget(index)
        out = best if out is None else out.unionByName(best)
    return out.select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"
    )


def oracle(k: int = 10) -> str:
    words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS (SELECT row, doc_id, {words} AS term FROM d),
n AS (SELECT row, count(*) AS n FROM t GROUP BY row),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
q AS (SELECT item, item_id, term, count(*) AS c FROM (
    SELECT item, item_id, {words} AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY ALL),
m AS (SELECT row, 100 - 75 + ((75 * n * docs) // len) AS m FROM n, s),
r AS (SELECT item, item_id, row, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
