"""Operator 2: scoring by a hierarchical Pitman-Yor language model.

Every previous word is a restaurant whose customers are the words that follow it; each of its tables sends one
customer to the parent that all share, whose own base is even over the vocabulary and one unknown word.  The
number of tables of each (context, word) is sampled given all other seats, sweep after sweep, and a word's
predictive probability is averaged over the samples after the burn-in.

A pair's tables t of its c customers are drawn from b**t * S(c, t): b is (strength + discount * tables of the context)
times the parent's probability, S the generalised Stirling numbers, which sum over all seatings with t tables.

Texts are dealt into chunks of a bounded size.  A chunk sends its distinct words and pairs, packed and sorted, to the
partitions that hold them and gets their counts and tables back in the same order, so one row stands for
thousands of words and nothing that grows with the corpus is broadcast.  Words are known by 64-bit hashes;
once counted they are numbered, and pairs travel as numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import wordhash
from reviewlake.llm.common import bounded_batches, held_out, id_and_text, settle, swept

CHUNK_BYTES = 8 * 1024 * 1024
END = np.uint64(0x1234567890ABCDEF)
# Discounts and strengths of the contexts and of their parent.
DISCOUNT, STRENGTH = 0.6, 20.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 1.0
BURN_IN, SAMPLES = 2, 4
FOLDS, HELD_OUT = 5, 1
# Beyond so many customers of one pair, tables are drawn by seating customers in blocks.
EXACT = 64


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
        parts += [struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(raw)), raw]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(blob[0]):
        kind, n, size = struct.unpack_from("<2sQQ", blob, at)
        raw = zstandard.ZstdDecompressor().decompress(blob[at + 18 : at + 18 + size], max_output_size=n * 8 + 8)
        out.append(np.frombuffer(raw, np.dtype("<" + kind.decode()), n))
        at += 18 + size
    return out


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_MESSAGE = "kind int, chunk int, bucket int, a double, b double, blob binary"
_NAMES = ["kind", "chunk", "bucket", "a", "b", "blob"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]


def _messages(rows: list[tuple]) -> pa.Table:
    return _rows(rows, _NAMES, _TYPES)


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    """Even, and in the order of the hashes."""
    return ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """The tokens of a chunk's texts, its distinct words and its distinct pairs, all in a fixed order."""

    def __init__(self, blobs: list[bytes]):
        parts = [unpack(b) for b in blobs]
        self.ids = np.concatenate([p[0] for p in parts])
        self.known_id = np.concatenate([p[1] for p in parts]).astype(bool)
        self.train = np.concatenate([p[2] for p in parts]).astype(bool)
        hasher = wordhash.Hasher()
        words, counts = [], []
        for _, _, _, size, data in parts:
            # Each text is followed by a newline here, so no word crosses into the next one.
            start, end = wordhash.spans(~wordhash.SPACES[data])
            words.append(hasher.spans(hasher.sums(wordhash.LOWER[data]), start, end))
            counts.append(np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))))
        words, counts = np.concatenate(words), np.concatenate(counts)
        self.n_tokens = counts + 1
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.n_tokens)
        tokens = np.full(len(self.doc), END, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.word = self.word.astype(np.int32)
        # The context of a text's first word is the end of a text.
        end = np.searchsorted(self.words, END)
        self.context = np.concatenate([[end], self.word[:-1]]).astype(np.int32)
        self.learns = self.train[self.doc]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.learns], minlength=len(self.words))

    def pairs(self, buckets: int, heavy: np.ndarray) -> None:
        """Distinct pairs by bucket, context and word: a context's pairs meet in its bucket, those of a heavy one spread."""
        n = len(self.words)
        key, of = np.unique(self.context.astype(np.int64) * n + self.word, return_inverse=True)
        u, w = (key // n).astype(np.int32), (key % n).astype(np.int32)
        del key
        own = bucket_of(self.words, buckets)
        bucket = own[u]
        spread = np.isin(self.words[u], heavy)
        bucket[spread] = (own[u[spread]] + own[w[spread]]) % buckets
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.u, self.w, self.bucket, self.pair = u[order], w[order], bucket[order], back[of]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def log_stirling(most: int, discount: float) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers: all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(0, c - 1 - discount * t)) + out[c - 1, 1 : c + 1]
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], stay)
    return out


def draw_tables(c: np.ndarray, b: np.ndarray, discount: float, stirling: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Tables of each dish with c customers, given the weight b of a new table."""
    t = np.minimum(c, 1).astype(np.int64)
    small = np.flatnonzero((c >= 2) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    begin = runs(c[small])
    for at, to in zip(begin, np.append(begin[1:], len(small))):
        of = small[at:to]
        size = int(c[of[0]])
        logits = np.log(b[of])[:, None] * np.arange(1, size + 1) + stirling[size, 1 : size + 1]
        weight = np.exp(logits - logits.max(1, keepdims=True))
        upto = np.cumsum(weight, axis=1)
        t[of] = 1 + (upto < random.random(len(of))[:, None] * upto[:, -1:]).sum(1).clip(max=size - 1)
    large = np.flatnonzero(c > EXACT)
    seated = np.ones(len(large), np.int64)
    while True:
        left = np.flatnonzero(seated < c[large])
        if not len(left):
            break
        of = large[left]
        step = np.minimum(c[of] - seated[left], np.maximum(1, seated[left] // 8))
        t[of] += random.binomial(step, b[of] / (b[of] + seated[left] - discount * t[of]))
        seated[left] += step
    return t


def _packed(docs: DataFrame, chunks: int, fold: int, folds: int) -> DataFrame:
    """chunk, blob: the texts of each chunk, compressed; many rows of a chunk, none larger than a few MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for chunk, rows in sorted(held.items()):
                ids = np.array([r[0] or 0 for r in rows], np.int64)
                known = np.array([r[0] is not None for r in rows], np.uint8)
                train = np.array([r[1] for r in rows], np.uint8)
                sizes = np.array([len(r[2]) + 1 for r in rows], np.int64)
                data = np.frombuffer(b"\n".join([*(r[2] for r in rows), b""]), np.uint8)
                blob = pack(ids, known, train, sizes, data)
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "blob"])
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "doc_id", "train")]
            for chunk, key, train, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                held.setdefault(chunk, []).append((key, train, text))
                size += len(text)
                if size > 2 * CHUNK_BYTES:
                    yield from out()
                    size = 0
        yield from out()

    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), F.length("text")), F.lit(chunks)).cast("int")
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"), folds, fold)).alias("train"), place.alias("chunk"))
    return rows.mapInArrow(run, "chunk int, blob binary")


def score(
    docs: DataFrame,
    folds: int = FOLDS,
    fold: int = HELD_OUT,
    discount: float = DISCOUNT,
    strength: float = STRENGTH,
    parent_discount: float = PARENT_DISCOUNT,
    parent_strength: float = PARENT_STRENGTH,
    burn_in: int = BURN_IN,
    samples: int = SAMPLES,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text.

    Held-out rows (crc32 of the id modulo `folds` is `fold`) are scored and not learnt from.  NULL and empty texts have
    one token, the end; a NULL id counts as empty text for the fold; repeated rows count and are scored each; an empty
    table gives no rows; without training rows every word is unknown and equally likely.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK_BYTES))
    packed = _packed(rows, n, fold, folds)

    # 1. Words: each chunk sends its distinct words and counts, each bucket adds them up and answers.
    def ask_words(table: pa.Table) -> pa.Table:
        own = Chunk(table.column("blob").to_pylist())
        count, bucket = own.word_counts(), bucket_of(own.words, n)
        chunk = table.column("chunk")[0].as_py()
        edges = np.searchsorted(bucket, np.arange(n + 1))
        return _messages(
            [(0, chunk, b, 0.0, 0.0, pack(own.words[i:j], count[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
        )

    def count_words(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = sorted(zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()))
        chunks, sent = [p[0] for p in parts], [unpack(p[1]) for p in parts]
        words, of = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        total = np.bincount(of, np.concatenate([s[1] for s in sent])).astype(np.int64)
        out = [(1, -1, bucket, float(total.sum()), float((total > 0).sum()), None), (5, -1, bucket, float(len(words)), 0.0, None)]
        at = 0
        for chunk, (own, _) in zip(chunks, sent):
            index = of[at : at + len(own)]
            at += len(own)
            out.append((2, chunk, bucket, 0.0, 0.0, pack(total[index])))
            out.append((3, chunk, bucket, 0.0, 0.0, pack(index.astype(np.uint32))))
        often = np.flatnonzero(total * 2 * n >= total.sum())  # at most 2 n words
        out += [(4, -1, bucket, float(total[i]), float(i), pack(words[i : i + 1])) for i in often if total[i]]
        return _messages(out)

    words = settle(
        packed.groupBy("chunk").applyInArrow(ask_words, _MESSAGE).groupBy("bucket").applyInArrow(count_words, _MESSAGE)
    )
    swept(spark)
    total = words.filter("kind = 1").agg(F.sum("a"), F.sum("b")).first()
    n_train, n_words = int(total[0] or 0), int(total[1] or 0)
    # The words of a bucket are numbered from its base on; as many numbers pass the driver as there are buckets.
    many = np.zeros(n, np.int64)
    for r in words.filter("kind = 5").select("bucket", "a").collect():
        many[r.bucket] = int(r.a)
    base = np.concatenate([[0], np.cumsum(many)])
    number = np.dtype("<u4" if base[-1] < 1 << 32 else "<u8")
    # Contexts with more than half a bucket's share of all words: 2 n at most.
    often = words.filter((F.col("kind") == 4) & (F.col("a") * 2 * n >= n_train)).select("bucket", "b", "blob").collect()
    often = sorted((int(unpack(r.blob)[0][0]), int(base[r.bucket]) + int(r.b)) for r in often)
    heavy = np.array([h for h, _ in often], np.uint64)
    heavy_number = np.array([i for _, i in often], np.int64)

    # 2. Pairs: each chunk sends its distinct pairs with counts and the words' first probabilities.
    def ask_pairs(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_of.num_rows:
            return _messages([])
        own = Chunk(docs_of.column("blob").to_pylist())
        total = _answers(answers, 2)[0]
        numbers = base[bucket_of(own.words, n)] + _answers(answers, 3)[0]
        own.pairs(n, heavy)
        count = np.bincount(own.pair[own.learns], minlength=len(own.u)).astype(np.uint32)
        p = (total + 0.5) / (n_train + 0.5 * (n_words + 1))
        code = np.clip(np.rint(-8 * np.log2(p)), 0, 255).astype(np.uint8)
        chunk = docs_of.column("chunk")[0].as_py()
        edges = np.searchsorted(own.bucket, np.arange(n + 1))
        out = []
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                begin = runs(own.u[i:j])
                length = np.diff(np.append(begin, j - i)).astype(np.uint32)
                u, w = numbers[own.u[i:j][begin]], own.w[i:j]
                out.append((0, chunk, b, 0.0, 0.0, pack(u.astype(number), length, numbers[w].astype(number), count[i:j], code[w])))
        return _messages(out)

    stirling = log_stirling(EXACT, discount)

    def seat(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = sorted(zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()))
        chunks, sent = [p[0] for p in parts], [unpack(p[1]) for p in parts]
        contexts, u = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        u = np.repeat(u.astype(np.int32), np.concatenate([s[1] for s in sent]))
        w = np.concatenate([s[2] for s in sent])
        order = np.lexsort((w, u))
        same = (u[order][1:] == u[order][:-1]) & (w[order][1:] == w[order][:-1])
        of = np.empty(len(order), np.int32)
        of[order] = np.concatenate([[0], np.cumsum(~same)])
        first = order[np.concatenate([[True], ~same])]
        c = np.bincount(of, np.concatenate([s[3] for s in sent])).astype(np.int64)
        u1, w1 = u[first], w[first]
        p = 2.0 ** (-np.concatenate([s[4] for s in sent])[first] / 8.0)
        del order, same, w
        random = np.random.default_rng([seed, 1, bucket])
        t = np.minimum(c, 1)
        sums, tables = np.zeros(len(c), np.int64), np.zeros(len(contexts))
        many = np.flatnonzero(c > 1)
        # A heavy context's pairs are spread evenly: its tables are about n times those here.
        times = np.where(np.isin(contexts, heavy_number), float(n), 1.0)
        for sweep in range(burn_in + samples):
            of_context = np.bincount(u1, t, minlength=len(contexts))
            b = (strength + discount * (of_context * times)[u1[many]]) * p[many]
            t[many] = draw_tables(c[many], b, discount, stirling, random)
            if sweep >= burn_in:
                sums += t
                tables += np.bincount(u1, t, minlength=len(contexts))
        tables /= samples
        out, at = [], 0
        for chunk, s in zip(chunks, sent):
            pair = of[at : at + len(s[3])]
            at += len(s[3])
            context = np.searchsorted(contexts, s[0])
            out.append((2, chunk, bucket, 0.0, 0.0, pack(c[pair].astype(np.uint32), sums[pair].astype(np.uint32), tables[context].astype(np.float32))))
        for i in np.flatnonzero(times > 1):
            out.append((4, -1, bucket, float(tables[i]), float(contexts[i]), None))
        # What the tables send to the parent, by the bucket of the word.
        alive = np.flatnonzero(c)
        names, which = np.unique(w1[alive], return_inverse=True)
        sent_up = np.bincount(which, sums[alive] / samples).astype(np.float32)
        edges = np.searchsorted(names, base)
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                out.append((5, -1, b, 0.0, 0.0, pack((names[i:j] - base[b].astype(number)).astype(np.uint32), sent_up[i:j])))
        return _messages(out)

    asked = packed.groupBy("chunk").cogroup(words.filter("kind IN (2, 3)").groupBy("chunk")).applyInArrow(ask_pairs, _MESSAGE)
    pairs = settle(asked.groupBy("bucket").applyInArrow(seat, _MESSAGE))
    swept(spark)
    spread = pairs.filter("kind = 4").groupBy("b").agg(F.sum("a").alias("a")).collect()  # 2 n at most
    spread = {int(r.b): r.a for r in spread}
    heavy_tables = np.array([spread.get(i, 0.0) for i in heavy_number.tolist()])

    # 3. The parent: its customers are the contexts' tables.
    def seat_parent(state: pa.Table, tables: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _messages([])
        kinds = state.column("kind").to_pylist()
        blobs, chunk_of = state.column("blob").to_pylist(), state.column("chunk").to_pylist()
        bucket = state.column("bucket")[0].as_py()
        customers = np.zeros(many[bucket])
        for blob in sorted(tables.column("blob").to_pylist()):
            index, sent = unpack(blob)
            customers[index] += sent
        c = np.rint(customers).astype(np.int64)
        random = np.random.default_rng([seed, 2, bucket])
        weight = (parent_strength + parent_discount * n_words) / (n_words + 1)
        rows_at = log_stirling(EXACT, parent_discount)
        seats = sum(
            draw_tables(c, np.full(len(c), weight), parent_discount, rows_at, random) for _ in range(samples)
        ) / samples
        out = [(6, -1, bucket, float(customers.sum()), float(seats.sum()), None)]
        for kind, chunk, blob in zip(kinds, chunk_of, blobs):
            if kind == 3:
                index = unpack(blob)[0]
                mass = customers[index] - parent_discount * seats[index]
                out.append((7, chunk, bucket, 0.0, 0.0, pack(mass.astype(np.float32))))
        return _messages(out)

    state = words.filter("kind = 3").groupBy("bucket")
    parent = settle(state.cogroup(pairs.filter("kind = 5").groupBy("bucket")).applyInArrow(seat_parent, _MESSAGE))
    swept(spark)
    total = parent.filter("kind = 6").agg(F.sum("a"), F.sum("b")).first()
    all_customers, all_tables = float(total[0] or 0), float(total[1] or 0)
    rest = (parent_strength + parent_discount * all_tables) / (n_words + 1)

    # 4. Scores: counts, tables and the parent's probabilities come back to each chunk in the order it asked.
    def judge(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not docs_of.num_rows:
            return _rows([], names, types)
        own = Chunk(docs_of.column("blob").to_pylist())
        count = _answers(answers, 2, "count")[0]
        own.pairs(n, heavy)
        c, sums, tables = _answers(answers, 2, "pair")
        mass = _answers(answers, 7, "parent")[0]
        p = (mass + rest) / (parent_strength + all_customers)
        begin = np.flatnonzero(np.concatenate([[True], (own.u[1:] != own.u[:-1]) | (own.bucket[1:] != own.bucket[:-1])]))
        of_context = np.repeat(tables.astype(float), np.diff(np.append(begin, len(own.u))))
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, own.words), len(heavy) - 1)
            of_context = np.where((heavy[at] == own.words)[own.u], heavy_tables[at][own.u], of_context)
        stay = np.where(c > 0, c - discount * sums / samples, 0)
        chance = (stay + (strength + discount * of_context) * p[own.w]) / (strength + count[own.u])
        logs = np.log10(chance)[own.pair]
        base = np.log10((count + 0.5) / (n_train + 0.5 * (n_words + 1)))[own.word]
        k = len(own.ids)
        columns = [
            pa.array(own.ids, pa.int64(), mask=~own.known_id),
            pa.array(own.n_tokens, pa.int64()),
            pa.array(np.bincount(own.doc, count[own.word] > 0, k).astype(np.int64)),
            pa.array(np.bincount(own.doc, base, k)),
            pa.array(np.bincount(own.doc, logs, k)),
        ]
        return pa.table(columns, names=names)

    kept = ["chunk", "kind", "bucket", "blob"]
    answers = words.filter("kind = 2").select(*kept, F.lit("count").alias("what"))
    answers = answers.union(pairs.filter("kind = 2").select(*kept, F.lit("pair")))
    answers = answers.union(parent.filter("kind = 7").select(*kept, F.lit("parent")))
    scored = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        judge, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _answers(table: pa.Table, kind: int, what: str | None = None) -> list[np.ndarray]:
    """The answers to a chunk's questions, bucket after bucket."""
    names = table.column("what").to_pylist() if what else [None] * table.num_rows
    rows = zip(table.column("kind").to_pylist(), names, table.column("bucket").to_pylist(), table.column("blob").to_pylist())
    parts = [unpack(blob) for _, blob in sorted((b, x) for k, w, b, x in rows if k == kind and w == what)]
    return [np.concatenate(column) for column in zip(*parts)]
