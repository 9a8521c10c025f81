"""Operator 1: BPE encoding and decoding by one walk over a trie of distinct words.

The encoding of a word's prefix ends in one *last token*; without it remains the encoding of a shorter prefix.
So a state of one token per trie node is enough: at a node, the last token is the longest vocabulary entry
ending there that is compatible with the last token of the node where it begins.  Two tokens are compatible
if encoding their joined text gives exactly these two.  Prefixes shared by words are computed once.

The trie of a batch's distinct words is kept as the sorted words, which is its order depth first: moving to
the next word pops the states below the shared prefix and pushes the rest.

Letters and digits are those of Python's Unicode tables; characters a newer Unicode adds count as symbols.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlake.llm.common import bounded_batches, freeing, id_and_text, slices

END = "</w>"
# Words kept between batches; beyond it the cache starts anew, results are the same.
CACHE_WORDS = 200_000
CACHE_PAIRS = 200_000


def _class(kind: str, most: int) -> str:
    """Ranges of a character class: every character up to `most` whose category begins with `kind`."""
    found, start = [], None
    for i in range(most + 2):
        inside = i <= most and unicodedata.category(chr(i)).startswith(kind)
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(found)


def word_pattern(most: int) -> re.Pattern:
    """Finds the words of texts whose characters go up to `most`; a short class is a fast one."""
    letters, numbers = _class("L", most), _class("N", most)
    other = f"(?:[^\\s{letters}{numbers}]|[\x1c-\x1f])+"
    # The contractions and character classes of the tokenizer's pre-tokenizer.
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|{other}")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends"; built once per task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self._made = {x + y: (i, (x, y)) for (x, y), i in reversed(self.rank.items())}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.special = special
        self.tokens = dict(zip(self.vocab.values(), self.vocab)) | {i: t for t, i in special.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self._patterns: dict[int, re.Pattern] = {}
        self._byte = dict(enumerate(byte_alphabet()))
        # Vocabulary entries read backwards, as nested dictionaries; "" holds the entry's id.  The walk
        # stops as soon as the text behind a node ends no entry.
        self._inner: dict = {}
        self._final: dict = {}
        self._size: dict[int, int] = {}
        for token, number in self.vocab.items():
            ends = token.endswith(END) and len(token) > len(END)
            body, node = (token[: -len(END)], self._final) if ends else (token, self._inner)
            for c in reversed(body):
                node = node.setdefault(c, {})
            node[""] = number
            self._size[number] = len(body)
        self._pairs: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[str, int]]:
        """Parts at the left (0) or right (1) edge of a token while it is made, and the rank that ends each."""
        at, ends, out = self.tokens[token], 1 << 60, []
        while True:
            out.append((at, ends))
            if at not in self._made:
                return out
            ends = self._made[at][0]
            at = self._made[at][1][side]

    def _compatible(self, a: int, b: int) -> bool:
        """No merge reaches across the border before both tokens are whole (of equal ranks the left goes first)."""
        if a not in self._right:
            self._right[a] = self._spine(a, 1)
        if b not in self._left:
            self._left[b] = self._spine(b, 0)
        rank = self.rank.get
        for x, x_ends in self._right[a]:
            for y, y_ends in self._left[b]:
                across = rank((x, y))
                if across is not None and across < x_ends and across <= y_ends:
                    return False
        return True

    def _last(self, text: str, depth: int, last: list[int], node: dict) -> int:
        """The last token of text[:depth]; last has the one of every shorter prefix, node the entries to try."""
        pairs, start, behind = self._pairs, depth, []
        while start:
            start -= 1
            node = node.get(text[start])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                if not start:
                    return token
                behind.append(last[start] << 32 | token)
        for pair in reversed(behind):
            fits = pairs.get(pair)
            if fits is None:
                fits = pairs[pair] = self._compatible(pair >> 32, pair & 0xFFFFFFFF)
            if fits:
                return pair & 0xFFFFFFFF
        raise ValueError(f"no token ends {text[:depth]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of every distinct word (in the byte alphabet), in one walk over their trie."""
        out: dict[str, list[int]] = {}
        last: list[int] = [-1]  # last[d]: last token of the first d characters of the word at hand
        before = ""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word) - 1, len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word)):
                last.append(self._last(word, depth, last, self._inner))
            token, at, ids = self._last(word, len(word), last, self._final), len(word), []
            while True:
                ids.append(token)
                at -= self._size[token]
                if at <= 0:
                    break
                token = last[at]
            out[word] = ids[::-1]
            before = word
        if len(self._pairs) > CACHE_PAIRS:
            self._pairs.clear()
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text in order, lower-cased; a special token is a word of its own."""
        if "<|" not in text:
            return self._plain_words(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [*self._plain_words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        # Sigma is lowered without regard to its place in the word.
        if text.isascii():
            return self._pattern(0x7F).findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return self._pattern(sys.maxunicode if wide else 0xFFFF).findall(text)

    def _pattern(self, most: int) -> re.Pattern:
        if most not in self._patterns:
            self._patterns[most] = word_pattern(most)
        return self._patterns[most]

    def encode_distinct(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word of words(), as little-endian 32-bit integers."""
        letters = {w: "".join(map(self._byte.__getitem__, w.encode())) for w in words if w not in self.special}
        ids = self.encode_words(letters.values())
        return {w: struct.pack(f"<{len(x)}I", *x) for w, x in ((w, ids[t]) for w, t in letters.items())} | {
            w: struct.pack("<I", self.special[w]) for w in words if w in self.special
        }

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' texts; the file names no decoder, so they are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Encodes runs of texts; keeps the ids of words it has met."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [self.bpe.words(t or "") for t in texts]
        words = set().union(*cut)
        new = words - self._known.keys()
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known, new = {}, words
        self._known |= self.bpe.encode_distinct(new)
        known = self._known.__getitem__
        for found in cut:
            yield b"".join(map(known, found))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text.

    NULL and empty texts have no ids; repeated rows are encoded each; other columns are not read.  A map without
    a shuffle: memory is bounded by one batch and the cache of words.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        gc.disable()  # millions of small objects and no cycles
        encoder = Encoder(path)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                parts = list(encoder.encode(texts))
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(freeing(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded ids of every row, special tokens included; NULL ids give an empty text."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(freeing(run), "doc_id long, text string")


def encode_and_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded again, digested in one pass.

    With keep_ids also ids, an array of int.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        gc.disable()  # millions of small objects and no cycles
        encoder = Encoder(path)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                count, ids_sha, text_sha, raws = [], [], [], []
                for raw in encoder.encode(texts):
                    ids = np.frombuffer(raw, "<u4")
                    count.append(len(ids))
                    raws.append(raw if keep_ids else b"")
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.bpe.decode(ids.tolist()).encode()).hexdigest())
                keys = batch.column("doc_id").slice(first, len(texts))
                columns = [keys, pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if keep_ids:
                    ends = pa.array(np.cumsum([0, *count], dtype=np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return id_and_text(docs, id_col, text_col).mapInArrow(freeing(run), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
