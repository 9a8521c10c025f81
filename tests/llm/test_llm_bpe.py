"""BPE against the tokenizers library."""

import hashlib
import random
import struct

import nasty
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from reviewlake.llm import bpe  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts(library):
    random.seed(2)
    letters = "abcdefghijst re ll ΣσςİıÉé'\x1c\x85\xa0\u0301\u200b漢字١٢ÄǅẞK9 9\n\t<|endoftext|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(4000)]
    texts += ["x<|endoftext|>y <|startoftext|><|endoftext|>", "a" * 5000, "e\u0301 \u0301", "<|", "'s's't", "don't I'LL"]
    got = bpe.Encoder(PATH).encode(texts)
    for text, raw, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == want.ids, text


def test_compatible_tokens_are_those_plain_merging_leaves_apart():
    words = bpe.WordBpe(PATH)

    def plain(symbols):
        while len(symbols) > 1:
            ranked = [(words.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    rng = random.Random(1)
    plain_tokens = [i for t, i in words.vocab.items() if not t.endswith(bpe.END)]
    for _ in range(3000):
        a, b = rng.choice(plain_tokens), rng.choice(plain_tokens)
        left, right = words.tokens[a], words.tokens[b]
        assert words._compatible(a, b) == (plain([*left, *right]) == [left, right])


def test_tables(spark, library):
    docs = nasty.documents(spark)
    want = {
        (i, t): library.encode(t or "", add_special_tokens=False).ids for i, t, _, _ in nasty.ROWS
    }
    encoded = bpe.encode(docs, PATH)
    rows = encoded.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(i), want[i, t]) for i, t, _, _ in nasty.ROWS)
    texts = bpe.decode(encoded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted(
        (str(i), library.decode(want[i, t], skip_special_tokens=False)) for i, t, _, _ in nasty.ROWS
    )
    digests = bpe.encode_and_decode(docs, PATH, keep_ids=True).collect()
    for r in digests:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(nasty.empty(spark), PATH).count() == 0


def test_a_full_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["one two three", "two three four five", "six one"] * 3
    encoder = bpe.Encoder(PATH)
    got = [list(struct.unpack(f"<{len(r) // 4}I", r)) for t in texts for r in encoder.encode([t])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
