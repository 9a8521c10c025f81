"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into partitions of correlated bits.  If two fingerprints differ in at most `most` bits and
the partitions' thresholds add up to `most - partitions + 1`, they differ within its threshold in one partition at
least; a threshold of -1 leaves a partition out.  Each fingerprint gets the thresholds of the lowest estimated
cost by dynamic programming over the partitions, probes the values within them and verifies what it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import bounded_batches, components, forget, freeing, id_and_text, matching, numbered, settle, slices, swept

BITS = 64
SEED = 42
# Histograms of partition values have at most this many bits; wider partitions are estimated from them.
HISTOGRAM_BITS = 16
# Cost of enumerating one value to probe, in candidates.
PROBE_COST = 1.0
_HASHES = 1 << 16


def hashed_shingles(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of all runs of so many words, in order; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        parts, total = iter([b" ".join(words)]), 1
    else:
        total = len(words) - shingle + 1
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64, total)


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority of each bit over the hashes of all word shingles; no words give zero."""
    hashes = hashed_shingles(text, shingle, seed)
    total = len(hashes)
    if not total:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, _HASHES):
        block = hashes[at : at + _HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row's whole text."""
    return _marked(id_and_text(docs, id_col, text_col), shingle, seed)


def _marked(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """The other columns, all of them long, and fp of the text."""
    bounded_batches(rows.sparkSession)
    keys = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, texts in slices(batch.column("text").cast(pa.binary())):
                found += [fingerprint(t, shingle, seed) for t in texts]
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(found, pa.int64())], names=[*keys, "fp"])

    return rows.mapInArrow(freeing(run), ", ".join(f"{c} long" for c in [*keys, "fp"]))


def correlated_partitions(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Bits dealt into `parts` groups of near-equal width: each group takes the free bit most correlated with it.

    Counts of ones and of common ones are sums over all fingerprints: 64 x 64 numbers, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = unpacked(np.asarray(batch.column("fp"))).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        cell = pa.array(np.arange(BITS * BITS))
        yield pa.record_batch([cell, pa.array(total.ravel())], names=["cell", "n"])

    sums = distinct.select("fp").mapInArrow(freeing(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in sums.collect():  # 64 x 64 numbers at most
        both[row.cell] = row.n
    n = max(1, distinct.count())
    both = both.reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    alike = np.abs(both - np.outer(p, p)) / spread
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        group = [min(free)]
        free -= {*group}
        while len(group) < (len(free) + len(group)) // left:
            group.append(max(free, key=lambda b: (alike[b, group].sum(), -b)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one partition as a number."""
    out = np.zeros(len(fp), np.int64)
    raw = np.asarray(fp, np.int64)
    for i, bit in enumerate(group):
        out |= ((raw >> bit) & 1) << i
    return out


def flips(width: int, distance: int) -> np.ndarray:
    """All masks of exactly `distance` of `width` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), distance)], np.int64)


def estimates(distinct: DataFrame, groups: list[list[int]], most: int) -> list[np.ndarray]:
    """Per partition: estimated candidates of each value at each threshold from 0 to `most`.

    Histograms over all fingerprints, of 2**16 values at most for a partition.
    """
    seen = [g[:HISTOGRAM_BITS] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(g), np.int64) for g in seen]
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for count, g in zip(counts, seen):
                count += np.bincount(values(fp, g), minlength=len(count))
        for i, count in enumerate(counts):
            at = np.flatnonzero(count)
            yield pa.record_batch(
                [pa.array(np.full(len(at), i)), pa.array(at), pa.array(count[at])], names=["part", "value", "n"]
            )

    sums = distinct.select("fp").mapInArrow(freeing(run), "part long, value long, n long")
    rows = sums.groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()  # parts x 2**16 rows at most
    out = []
    for i, g in enumerate(groups):
        width, hidden = len(seen[i]), len(g) - len(seen[i])
        count, of = np.zeros(1 << width), rows[rows.part == i]
        count[of.value] = of.n
        at = np.arange(1 << width)
        shells = []
        for d in range(most + 1):
            shell = np.zeros(1 << width)
            for mask in flips(width, d) if d <= width else ():
                shell += count[at ^ mask]
            shells.append(shell)
        within = []
        for t in range(most + 1):
            # Bits beyond the histogram are taken as even and independent.
            total = np.zeros(1 << width)
            for d in range(t + 1):
                total += shells[d] * sum(len(flips(hidden, e)) for e in range(t - d + 1)) / 2.0**hidden
            within.append(total)
        out.append(np.array(within, np.float32))
    return out


def allocate(fp: np.ndarray, groups: list[list[int]], expected: list[np.ndarray], most: int) -> np.ndarray:
    """Thresholds (row, partition) of least estimated cost that add up to most - partitions + 1."""
    goal, offset, n = most - len(groups) + 1, len(groups), len(fp)
    size = goal + 2 * offset + 1  # sums on the way run from -partitions to goal + partitions
    best = np.full((size, n), np.inf, np.float32)
    best[offset] = 0  # the sum so far is zero
    picks = []
    for i, g in enumerate(groups):
        value = values(fp, g[:HISTOGRAM_BITS])
        after = np.full((size, n), np.inf, np.float32)
        pick = np.full((size, n), -1, np.int8)
        probes = 0
        for t in range(-1, most + 1):
            if t >= 0:
                probes += len(flips(len(g), t))
                cost = expected[i][t][value] + np.float32(PROBE_COST * probes)
            else:
                cost = np.zeros(n, np.float32)
            for s in range(size):
                if 0 <= s + t < size:
                    total = best[s] + cost
                    less = total < after[s + t]
                    after[s + t][less] = total[less]
                    pick[s + t][less] = t
        best = after
        picks.append(pick)
    out = np.zeros((n, len(groups)), np.int8)
    state = np.full(n, goal + offset)
    for i in range(len(groups) - 1, -1, -1):
        out[:, i] = picks[i][state, np.arange(n)]
        state = state - out[:, i]
    return out


def best_parts(n: int, most: int) -> int:
    """The number of partitions of least work for n fingerprints: values probed and candidates met, spread evenly."""

    def work(parts: int) -> float:
        width, goal, total = BITS // parts, most - parts + 1, 0.0
        if goal < -parts:
            return float("inf")
        thresholds = [goal // parts + (i < goal % parts) for i in range(parts)]
        for t in thresholds:
            total += sum(math.comb(width, d) for d in range(t + 1)) * (PROBE_COST + n / 2.0**width)
        return total

    return min(range(2, 9), key=work)


def links(distinct: DataFrame, most: int = 3, parts: int | None = None) -> DataFrame:
    """a, b: all pairs of distinct fingerprints that differ in 1 to `most` bits, a < b.

    Every number of partitions gives all pairs; without one, that of least estimated work is taken.
    """
    parts = parts or best_parts(distinct.count(), most)
    groups = correlated_partitions(distinct, parts)
    expected = estimates(distinct, groups, most)
    masks = [[flips(len(g), d) for d in range(most + 1)] for g in groups]
    # Sent once to each executor: parts x (most + 1) x 2**16 numbers at most, 4 MB here.
    shared = distinct.sparkSession.sparkContext.broadcast(expected)
    names = ["part", "value", "fp"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for i, g in enumerate(groups):
                part = pa.array(np.full(len(fp), i, np.int32))
                yield pa.record_batch([part, pa.array(values(fp, g)), pa.array(fp)], names=names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            thresholds = allocate(fp, groups, shared.value, most)
            for i, g in enumerate(groups):
                value = values(fp, g)
                for d in range(most + 1):
                    of = np.flatnonzero(thresholds[:, i] >= d)
                    for mask in masks[i][d] if len(of) else ():
                        part = pa.array(np.full(len(of), i, np.int32))
                        yield pa.record_batch([part, pa.array(value[of] ^ mask), pa.array(fp[of])], names=names)

    schema = "part int, value long, fp long"
    # Few bytes, but many probes each: dealt out evenly, whatever the files they lie in.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = distinct.select("fp").repartition(tasks).mapInArrow(freeing(probe), schema).withColumnRenamed("fp", "a")
    there = distinct.select("fp").mapInArrow(freeing(index), schema).withColumnRenamed("fp", "b")
    near = found.join(there, ["part", "value"]).filter(f"a < b AND bit_count(a ^ b) <= {most}")
    return near.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, most: int = 3, parts: int | None = None, seed: int = SEED, id_col="doc_id", text_col="text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Rows link if their fingerprints differ in `most` bits or fewer; a component is named by its smallest doc_id.
    NULL and empty texts have fingerprint zero and link like any other; repeated rows stay repeated; a NULL doc_id
    names no component unless nothing else is in it; an empty table gives no rows.  Equal fingerprints are one node.
    """
    marked = settle(fingerprints(docs, shingle, seed, id_col, text_col))
    named = _named(marked, F.min("doc_id"), "component_id", most, parts)
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _named(marked: DataFrame, least: Column, name: str, most: int, parts: int | None) -> DataFrame:
    """fp and the name of its component, the smallest of what `least` takes from its rows, as a written table."""
    distinct = settle(marked.groupBy("fp").agg(least.alias("least")))
    of = components(links(distinct, most, parts), "a", "b")
    of = distinct.join(of, distinct.fp == of.node, "left").select(
        distinct.fp, F.coalesce("root", distinct.fp).alias("root"), "least"
    )
    of = settle(of)
    named = of.groupBy("root").agg(F.min("least").alias(name))
    named = settle(of.join(named, "root").select("fp", name))
    forget(distinct, of)
    return named


# similar_groups(): minima of a set of shingles, keys made of so many of them each, and the words of its fingerprint, a bit of
# each minimum.  At a similarity of 0.8 two sets share none of the 36 keys with 1 in 1800.
MINIMA, PER_KEY, KEYS = 256, 7, 36
WORDS = MINIMA // 64
# Fingerprints of sets of similarity s differ in (1 - s) / 2 of their bits.  So many standard deviations beyond that a pair is
# taken for unlike: 1 in 1000 at the threshold.
DEVIATIONS = 3.1
# Rows beside their key's largest component meet so many of its rows, in so many rounds, before they meet all.
PARTNERS, ROUNDS = 4, 2
_BLOCK = 4096


def _factors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.random.default_rng(seed).integers(0, 2**32, (2, MINIMA, 1), np.uint32, endpoint=False) | np.uint32(1)
    return both[0], both[1]


def minima(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The least value of each of MINIMA hash functions over a set of hashes; two sets share one with their similarity."""
    a, b = _factors(seed)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), _BLOCK):
        mixed = low[at : at + _BLOCK] * a
        mixed += high[at : at + _BLOCK] * b
        np.minimum(least, mixed.min(1), out=least)
    return least


def keys_and_bits(hashes: np.ndarray, seed: int) -> tuple[list[int], np.ndarray]:
    """Independent keys of a set of hashes, and its fingerprint; an empty set has a key of its own."""
    if not len(hashes):
        return [seed], np.zeros(WORDS, np.int64)
    least = minima(hashes, seed)
    keys = [xxhash.xxh64_intdigest(least[i * PER_KEY : (i + 1) * PER_KEY].tobytes(), i) - 2**63 for i in range(KEYS)]
    return keys, np.packbits((least >> np.uint32(9) & np.uint32(1)).astype(np.uint8)).view(np.int64)


def most_differing(similarity: float) -> int:
    """Bits in which the fingerprints of a pair at the similarity hardly ever differ more."""
    p = (1 - similarity) / 2
    return math.floor(MINIMA * p + DEVIATIONS * math.sqrt(MINIMA * p * (1 - p)))


def _unlike(x: str, y: str, most: int) -> Column:
    """Do two fingerprints (arrays of words) differ in more bits?"""
    words = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(WORDS)]
    return sum(words[1:], words[0]) > most


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = SEED, id_col="doc_id", text_col="text", most: int | None = None
) -> DataFrame:
    """row, doc_id, root (a row): rows connected by a similarity of their word shingles of at least `similarity`.

    Rows that share a key of their shingles' minima are compared, first by their fingerprints' differing bits, and the exact
    Jaccard similarity decides.  Both chances depend on the similarity alone, neither on the length of the texts nor on where
    they differ.  Rows with a common key are compared until each pair of them is in one component or was found unlike.  Texts
    without words are similar to one another; a NULL text is empty.  Repeated rows are similar rows; an empty table gives none.

    With `most`, rows are connected first as near_duplicates() connects them, by SimHash fingerprints that differ in so many bits;
    then similar rows are sought that are in different components.
    """
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.select(F.col("row").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                found = [keys_and_bits(np.unique(hashed_shingles(t, shingle, seed)), seed) for t in texts]
                lists = []
                for each in ([k for k, _ in found], [b for _, b in found]):
                    ends = pa.array(np.cumsum([0, *map(len, each)], dtype=np.int32))
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.array(x, np.int64) for x in each]))))
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), *lists], names=["id", "keys", "bits"])

    marked = settle(keyed.mapInArrow(freeing(run), "id long, keys array<long>, bits array<long>"))
    near = None if most is None else _near_links(rows, most, seed)
    verified = lambda pairs: _similar(pairs, keyed, shingle, similarity, seed)
    # As a condition of a join of rows with their sets, s and of_s.
    last = (lambda ids: _sets(ids, keyed, shingle, seed), _alike("s", "of_s", similarity))
    known = _links(marked, verified, most_differing(similarity), near, last)
    of = components(known, "x", "y")
    forget(marked, known)
    ids = rows.select("row", "doc_id")
    return ids.join(of, ids.row == of.node, "left").select("row", "doc_id", F.coalesce("root", "row").alias("root"))


def _near_links(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """x, y: every row (row, doc_id, text) and the first one of its component of near_duplicates(), as a written table."""
    prints = settle(_marked(rows.select("row", "text"), 3, seed))
    named = _named(prints, F.min("row"), "first", most, None)
    out = settle(prints.join(named, "fp").filter("row <> first").select(F.col("first").alias("x"), F.col("row").alias("y")))
    forget(prints, named)
    return out


def _links(
    marked: DataFrame, verified: Callable[[DataFrame], DataFrame], most: int, known: DataFrame | None = None,
    last: tuple[Callable[[DataFrame], DataFrame], Column] | None = None,
) -> DataFrame:
    """x, y: links of marked rows (id, keys, bits) that connect all similar rows with a common key.

    verified() gives the similar ones of pairs x, y as a written table.  `known` are links to start from, a written table.
    `last` gives what the last comparison needs of ids, and its condition; rows are compared in a join then, and only links are made.
    """
    spark = marked.sparkSession
    each = marked.select("id", F.explode("keys").alias("key"))
    shared = settle(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    held = settle(each.join(shared, "key"))
    # The row that shares its keys with most others leads: in a family of copies it is the one they were made from.
    reach = settle(held.groupBy("id").agg(F.sum("n").alias("reach")))
    held_by = settle(held.select("key", "id").join(reach, "id"))
    lead = settle(held_by.groupBy("key").agg(F.max(F.struct("reach", "id")).alias("lead")).select("key", F.col("lead.id").alias("of")))
    pairs = held_by.join(lead, "key").filter("id <> of")
    found = _found(pairs, marked, verified, most)
    if known is not None:
        first, found = found, settle(found.union(known).distinct())
        forget(first, known)
    forget(shared, held, reach, lead)
    swept(spark)
    for turn in range(ROUNDS + 1):
        mixed = _mixed(held_by.select("key", "id"), found)
        if not mixed.head(1):
            forget(mixed)
            break
        beside = mixed.filter("beside")
        if turn < ROUNDS:
            # Some rows of the largest component, others for each key and turn.
            some = [F.max_by("id", F.xxhash64("id", "key", F.lit(turn * PARTNERS + i))) for i in range(PARTNERS)]
            partners = settle(mixed.filter("NOT beside").groupBy("key").agg(F.array_distinct(F.array(*some)).alias("of")))
            pairs = beside.join(partners, "key").select("id", F.explode("of").alias("of"))
            more = _found(pairs, marked, verified, most)
        elif last:
            more = _met_in_join(mixed, marked, *last, most)
        else:
            # All that are not connected yet, but for pairs whose fingerprints are unlike.
            with_bits = settle(mixed.join(marked.select("id", "bits"), "id"))
            others = with_bits.filter("beside").select("key", F.col("id").alias("of"), F.col("root").alias("of_root"), F.col("bits").alias("of_bits"))
            apart = (F.col("root") != F.col("of_root")) & (~F.col("beside") | (F.col("id") < F.col("of"))) & ~_unlike("bits", "of_bits", most)
            same = with_bits["key"] == others["key"]
            pairs = settle(with_bits.join(others, same & apart).select("id", "of").distinct())
            likely = settle(pairs.select(F.least("id", "of").alias("x"), F.greatest("id", "of").alias("y")).distinct())
            more = verified(likely)
            forget(with_bits, pairs, likely)
        before, found = found, settle(found.union(more).distinct())
        forget(before, more, mixed)
        swept(spark)
    forget(held_by)
    return found


def _met_in_join(mixed: DataFrame, marked: DataFrame, sets: Callable[[DataFrame], DataFrame], alike: Column, most: int) -> DataFrame:
    """x, y: the similar ones of all rows of a key in different components, as a written table.

    Two rows are compared in the least of their common keys.  All is a condition of the join: rows are made of links only.
    """
    ids = settle(mixed.select("id").distinct())
    own = sets(ids)
    rows = settle(mixed.join(matching(marked, ids, "id", "left_semi").join(own, "id"), "id"))
    others = rows.filter("beside").select(*(F.col(c).alias(f"of_{c}") for c in ("key", "id", "root", "bits", "keys", "s")))
    apart = (F.col("root") != F.col("of_root")) & (~F.col("beside") | (F.col("id") < F.col("of_id"))) & ~_unlike("bits", "of_bits", most)
    here = F.array_min(F.array_intersect("keys", "of_keys")) == F.col("key")
    met = rows.join(others, (F.col("key") == F.col("of_key")) & apart & here & alike)
    out = settle(met.select(F.least("id", "of_id").alias("x"), F.greatest("id", "of_id").alias("y")).distinct())
    forget(ids, own, rows)
    return out


def _found(pairs: DataFrame, marked: DataFrame, verified: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The verified ones of pairs (id, of), as x, y."""
    pairs = settle(pairs.select(F.least("id", "of").alias("x"), F.greatest("id", "of").alias("y")).distinct())
    bits = lambda c: marked.select(F.col("id").alias(c), F.col("bits").alias(f"{c}_bits"))
    likely = pairs.join(bits("x"), "x").join(bits("y"), "y").filter(~_unlike("x_bits", "y_bits", most))
    likely = settle(likely.select("x", "y"))
    links = verified(likely)
    forget(pairs, likely)
    return links


def _mixed(held: DataFrame, links: DataFrame) -> DataFrame:
    """key, id, root, beside: the rows of keys that hold several components, and which are not in its largest."""
    of = components(links, "x", "y").withColumnRenamed("node", "id")
    placed = settle(held.join(of, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    largest = settle(most.select("key", F.col("most.root").alias("largest")))
    mixed = settle(placed.join(largest, "key").select("key", "id", "root", (F.col("root") != F.col("largest")).alias("beside")))
    forget(placed, largest)
    return mixed


def _sets(ids: DataFrame, rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """id, s: the sets of shingles of those rows (doc_id, text) that ids (id) name, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                sets = [np.unique(hashed_shingles(t, shingle, seed)).view(np.int64) for t in texts]
                ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), lists], names=["id", "s"])

    ids = ids.withColumnRenamed("id", "doc_id")
    return settle(matching(rows, ids, "doc_id", "left_semi").mapInArrow(freeing(run), "id long, s array<long>"))


def _alike(p: str, q: str, similarity: float) -> Column:
    common = F.size(F.array_intersect(p, q))
    total = F.size(p) + F.size(q) - common
    return (common >= F.lit(similarity) * total) | (total == 0)


def _similar(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """The pairs x, y of rows (doc_id, text) whose sets of shingles have the similarity at least, as a written table."""
    ids = settle(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    sets = _sets(ids, rows, shingle, seed)
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("p")), "x")
    both = both.join(sets.select(F.col("id").alias("y"), F.col("s").alias("q")), "y")
    out = settle(both.filter(_alike("p", "q", similarity)).select("x", "y"))
    forget(ids, sets)
    return out


def without_similar(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col="doc_id", text_col="text", most: int | None = None
) -> DataFrame:
    """The rows of docs, with all their columns: of each of similar_groups() that with the smallest doc_id (NULL last)."""
    found = similar_groups(docs, shingle, similarity, id_col=id_col, text_col=text_col, most=most)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = settle(found)
    first = found.groupBy("root").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    many = settle(first.filter("n > 1").select("root", F.col("first.row").alias("first")))
    dropped = settle(found.join(many, "root").filter("row <> first").select("row"))
    return matching(numbered(docs), dropped, "row", "left_anti").select("doc.*")
