"""Operator 13: alignment of the tokens of a byte-level tokenizer (A) and a sentencepiece model (B) over each text.

No token of either goes over a space between two visible characters, so texts are taken apart there, and each distinct
part is encoded and aligned once in a task; a text is its parts side by side.  Files for which that does not hold
are used on whole texts.

New parts are encoded many at a time, side by side.  The character offsets of A's tokens and the spans of B's pieces are
the coarse cuts: they say which part a token is of.  Inside a part, where characters are several bytes and one of them may be
several tokens, the tokens' decoded bytes say where each ends.  Where tokens of both end, a group ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.bpe import byte_alphabet
from reviewlake.llm.common import BATCH_BYTES, bounded_batches, freeing, id_and_text, settle, slices

# A space between two characters that are white space in no version of Unicode.
_WHITE = r"\s\x1c-\x1f\x85\u180e\u200b\u200e\u200f\ufeff"
BORDER = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
VISIBLE = re.compile(f"[^{_WHITE}]")
MARK = "\u2581"
# Parts kept between batches; beyond it the cache starts anew, results are the same.
CACHE_PARTS = 600_000
# Characters of new parts that are encoded together.
LEARN_CHARS = 1 << 15
# Pairs up to this number are sent to every executor (40 MB); more are met by a shuffled join.
FEW_PAIRS = 2_000_000


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """A vocabulary's decoded bytes and their lengths, as arrays."""

    def __init__(self, each: list[bytes]):
        self.size = np.array([len(t) for t in each], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(each), np.uint8)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then the same of the next."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


# Decimal numbers, as the groups are written.
def _numbers(most: int) -> Tokens:
    return Tokens([str(i).encode() for i in range(most)])


class Side:
    """The tokens of one tokenizer over some parts side by side, from their ids and the part each is of."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, tokens: Tokens, begins: np.ndarray):
        self.ids, self.of, self.size = ids, of, tokens.size[ids]
        ends = np.cumsum(self.size)
        first = np.searchsorted(of, np.arange(len(begins)))
        base = np.r_[0, ends][first]
        # Where each ends in the bytes of all parts, counted from its own part's begin.
        self.end = begins[of] + ends - base[of]
        self.total = np.bincount(of, self.size, len(begins)).astype(np.int64)
        self.tokens = tokens

    def wrong(self, data: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Parts, of those to keep, in which some token's bytes are not those of the text."""
        own = keep[self.of]
        ids, size, end = self.ids[own], self.size[own], self.end[own]
        differ = self.tokens.bytes[spread(self.tokens.start[ids], size)] != data[spread(end - size, size)]
        return np.unique(np.repeat(self.of[own], size)[differ])

    def only(self, keep: np.ndarray) -> None:
        own = keep[self.of]
        self.ids, self.of, self.end = self.ids[own], self.of[own], self.end[own]


class Aligner:
    """Both tokenizers and the alignments of the parts seen so far; one per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for t, i in vocabulary.items():
            a_bytes[i] = bytes(byte[c] for c in t if c in byte)
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_tokens, self.b_tokens = Tokens(a_bytes), Tokens(b_bytes)
        self.numbers = _numbers(max(len(a_bytes), len(b_bytes)))
        with open(a_path, encoding="utf-8") as f:
            parts = json.load(f)
        # Words split at spaces before anything else, and no piece that goes on over a space.
        split = parts["pre_tokenizer"] or {}
        self.apart = (
            parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and not any(MARK in p.lstrip(MARK) for p in pieces)
        )
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        # Of each part: A tokens, B tokens and groups (-1: the tokens' bytes are not the text's), groups as text, links as bytes.
        self.counts = np.zeros((0, 3), np.int64)
        self.groups: list[bytes] = []
        self.links: list[bytes] = []

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Encode and align parts that stand side by side, a space before each; their counts."""
        text = " ".join(parts)
        chars = np.array([len(p) + 1 for p in parts])
        sizes = np.array([len(p.encode()) + 1 for p in parts])
        char_begins, begins = np.cumsum(chars) - chars, np.cumsum(sizes) - sizes
        a = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text, return_type="proto").pieces
        a_at = np.array(a.offsets, np.int64).reshape(-1, 2)[:, 0]
        b_at = np.fromiter((p.begin for p in b), np.int64, len(b)) + 1  # the spans do not count the space in front
        sides = [
            Side(np.array(a.ids, np.int64), np.searchsorted(char_begins, a_at, "right") - 1, self.a_tokens, begins),
            Side(np.fromiter((p.id for p in b), np.int64, len(b)), np.searchsorted(begins, np.maximum(b_at, 0), "right") - 1, self.b_tokens, begins),
        ]
        n = len(parts)
        good = (sides[0].total == sizes) & (sides[1].total == sizes)
        data = np.frombuffer((" " + text).encode(), np.uint8)
        for side in sides:
            good[side.wrong(data, good)] = False
        for side in sides:
            side.only(good)
        x, y = sides
        # Tokens that end where one of the other side ends.
        cuts = []
        for mine, other in ((x, y), (y, x)):
            there = np.zeros(len(data) + 1, bool)
            there[other.end] = True
            cuts.append(there[mine.end])
        links = (x.ids[cuts[0]] * self.width + y.ids[cuts[1]]).astype(np.int32)
        of_link = x.of[cuts[0]]
        # Written as a1,a2|b1;a3|b2,b3; - each token with the sign behind it.
        group = np.r_[np.cumsum(cuts[0]) - cuts[0], np.cumsum(cuts[1]) - cuts[1]]
        second = np.r_[np.zeros(len(x.ids), np.int64), np.ones(len(y.ids), np.int64)]
        order = np.argsort(group * 2 + second, kind="stable")
        ids, of = np.r_[x.ids, y.ids][order], np.r_[x.of, y.of][order]
        sign = np.where(np.r_[cuts[0], cuts[1]], np.where(second == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)[order]
        digits = self.numbers.size[ids]
        ends = np.cumsum(digits + 1)
        written = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        written[spread(ends - 1 - digits, digits)] = self.numbers.bytes[spread(self.numbers.start[ids], digits)]
        written[ends - 1] = sign
        written, packed = written.tobytes(), links.tobytes()
        text_ends = np.cumsum(np.bincount(of, digits + 1, n)).astype(np.int64).tolist()
        link_counts = np.bincount(of_link, minlength=n)
        link_ends = (4 * np.cumsum(link_counts)).tolist()
        self.groups += [written[i:j] for i, j in zip([0, *text_ends], text_ends)]
        self.links += [packed[i:j] for i, j in zip([0, *link_ends], link_ends)]
        return np.where(good[:, None], np.stack([np.bincount(x.of, minlength=n), np.bincount(y.of, minlength=n), link_counts], 1), -1)

    def _know(self, parts: set[str]) -> None:
        new = parts.difference(self.place)
        if len(self.place) + len(new) > CACHE_PARTS:
            self._forget()
            new = parts
        # Parts with white space at an edge, as a text begins or ends with, are no neighbours for others.
        joined, alone = [], []
        seen = VISIBLE.match
        for part in new:
            (joined if self.apart and seen(part[0]) and seen(part[-1]) else alone).append(part)
        for part in (*joined, *alone):
            self.place[part] = len(self.place)
        counts, at, size = [self.counts], 0, 0
        for i, part in enumerate(joined):
            size += len(part) + 1
            if size > LEARN_CHARS or i == len(joined) - 1:
                counts.append(self._learn(joined[at : i + 1]))
                at, size = i + 1, 0
        self.counts = np.concatenate([*counts, *(self._learn([part]) for part in alone)])

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, bytes] | None]:
        """Of each text: A tokens, B tokens and groups, groups as text, links as bytes; None if it has no tokens."""
        split = BORDER.split if self.apart else lambda t: [t]
        parts = [split(t) if t else [] for t in texts]
        self._know(set().union(*parts))
        for own in parts:
            at = list(map(self.place.__getitem__, own))
            counts = self.counts[np.array(at, np.int64)]
            if not at or (counts[:, 0] < 0).any():
                yield None
            else:
                yield counts.sum(0), b"".join(map(self.groups.__getitem__, at))[:-1], b"".join(map(self.links.__getitem__, at))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col="doc_id", text_col="text", keep_groups: bool = False) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and each linked pair (A id x B's size + B id) with its count.

    With keep_groups, also the groups as text (`a1,a2|b1;a3|b2,b3`).
    """
    bounded_batches(docs.sparkSession)
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts", *(["groups"] if keep_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = aligner(a_path, b_path)
        for batch in batches:
            for first, texts in slices(batch.column("text"), BATCH_BYTES):
                figures, digests, shown, pairs, counts = [], [], [], [], []
                for found in own.texts(texts):
                    if found is None:
                        figures.append((0, 0, 0, 0))
                        digests.append("")
                        shown.append("")
                        pairs.append(np.zeros(0, np.int32))
                        counts.append(np.zeros(0, np.int64))
                        continue
                    n, groups, links = found
                    each, times = np.unique(np.frombuffer(links, np.int32), return_counts=True)
                    figures.append((*n, len(links) // 4))
                    digests.append(hashlib.sha256(groups).hexdigest())
                    shown.append(groups.decode() if keep_groups else "")
                    pairs.append(each)
                    counts.append(times)
                ends = pa.array(np.cumsum([0, *map(len, pairs)], dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, counts)]
                columns = [batch.column(c).slice(first, len(texts)) for c in ("row", "doc_id")]
                columns += [pa.array(np.array(figures, np.int64)[:, i]) for i in range(4)] + [pa.array(digests), *lists]
                yield pa.record_batch([*columns, *([pa.array(shown)] if keep_groups else [])], names=names)

    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    schema = (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, counts array<long>"
    )
    return rows.mapInArrow(freeing(run), schema + (", groups string" if keep_groups else ""))


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, n, best: how many links of all texts hold each pair, and whether none of its B id's pairs has more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.*")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")).withColumn("b", F.col("pair") % width)
    total = settle(total)
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col="doc_id", text_col="text", keep_groups: bool = False
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; with keep_groups, groups.

    Links are the pairs of an A and a B token that end after the same byte of a space and the text.  A pair's count is the
    number of its links in all texts; n_best counts a text's links whose count no other pair of their B id exceeds, and
    count_sum adds the counts of all its links.  NULL and empty texts, and texts whose tokens' bytes are not those of a space
    and the text, have zeros and an empty digest.  Repeated rows are texts of their own and count each time.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    files = default_files()
    a_path, b_path = a_path or files[0], b_path or files[1]
    found = settle(aligned(docs, a_path, b_path, id_col, text_col, keep_groups))
    width = aligner(a_path, b_path).width
    counts = settle(pair_counts(found, width))
    names = [c for c in found.columns if c not in ("row", "pairs", "counts", "groups_sha256", "groups")]
    last = ["groups_sha256", *(["groups"] if keep_groups else [])]
    if counts.count() <= FEW_PAIRS:
        rows = counts.orderBy("pair").toPandas()
        shared = spark.sparkContext.broadcast((rows.pair.to_numpy(np.int32), rows.n.to_numpy(np.int64), rows.best.to_numpy(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = shared.value
            for batch in batches:
                lists = batch.column("pairs")
                size = np.asarray(pa.compute.list_value_length(lists))
                of = np.repeat(np.arange(len(size)), size)
                times = np.asarray(batch.column("counts").flatten())
                at = np.searchsorted(pair, np.asarray(lists.flatten()))
                sums = []
                for each in (times * best[at], times * n[at]):
                    total = np.zeros(len(size), np.int64)
                    np.add.at(total, of, each)
                    sums.append(pa.array(total))
                columns = [batch.column(c) for c in (*names, *last)]
                yield pa.record_batch([*columns, *sums], names=[*names, *last, "n_best", "count_sum"])

        schema = ", ".join([*(f"{c} long" for c in names), *(f"{c} string" for c in last), "n_best long", "count_sum long"])
        out = found.drop("row").mapInArrow(freeing(run), schema)
    else:
        each = found.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
        each = each.select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times")).join(counts, "pair")
        sums = each.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = found.join(sums, "row", "left").select(*names, *last, zero("n_best"), zero("count_sum"))
    return out.select(*names, "n_best", "count_sum", *last)
