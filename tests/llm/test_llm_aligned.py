"""Aligned tokens against whole texts encoded by the libraries, with all pairs of tokens compared."""

import hashlib
import random
from collections import Counter

import nasty
import pytest

from reviewlake.llm import aligned
from reviewlake.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

ODD = ["  two  spaces ", "tab\t x", "a  b c", "x 　 y", "é è́ 漢字 🙂🙂", "a ▁b", "\x00 \x1f z", "line\nnext \n end", "<s> <|endoftext|> </s>",
       "don't I'll we've", " lead", "trail ", "﻿bom x", "1 22 333 ½ ²", "e ́x", "a​ b", "\r\n", "᠎ x", "a  b c", "x\u0085 y", "𐍈𐍉 ܐܒ"]


def brute(rows):
    a_path, b_path = aligned.default_files()
    a = tokenizers.Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte = {c: bytes([i]) for i, c in enumerate(aligned.byte_alphabet())}
    out, all_links = [], []
    for i, text in rows:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        x_bytes = [b"".join(byte[c] for c in a.id_to_token(t)) for t in x]
        y_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode() for t in y for p in [b.id_to_piece(t)]]
        if not text or not b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
            out.append((i, 0, 0, 0, 0, ""))
            all_links.append([])
            continue
        ends = [[sum(map(len, s[: n + 1])) for n in range(len(s))] for s in (x_bytes, y_bytes)]
        at_x, at_y = ({e: n for n, e in enumerate(s)} for s in ends)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(x[at_x[c]], y[at_y[c]]) for c in cuts]
        groups, p, q = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, x[p : at_x[c] + 1])) + "|" + ",".join(map(str, y[q : at_y[c] + 1])))
            p, q = at_x[c] + 1, at_y[c] + 1
        out.append((i, len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        all_links.append(links)
    count = Counter(link for links in all_links for link in links)
    most = Counter()
    for (_, t), n in count.items():
        most[t] = max(most[t], n)
    rows = []
    for row, links in zip(out, all_links):
        rows.append((*row[:5], sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), row[5]))
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_alignment_equals_whole_texts(spark, few, monkeypatch):
    monkeypatch.setattr(aligned, "FEW_PAIRS", few)
    rng = random.Random(3)
    letters = ["a", "b", " ", " ", "é", "漢", "🙂", "\n", "'s", "1", ".", "́", " ", "the ", "ing ", "͸", "\U000105c0"]
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "the end"), (3, "the end"), (3, "the end"), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(aligned.align(df)) == brute(rows)


def test_table_and_groups(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("no test tables here")
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 20_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = aligned.align(df, keep_groups=True)
    assert got(out.drop("groups")) == brute(rows)
    for r in out.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")


def test_files_that_join_words_are_used_whole(monkeypatch):
    own = aligned.Aligner(*aligned.default_files())
    assert own.apart
    text = "one two  three été"
    apart = list(own.texts([text]))[0]
    own.apart = False
    own._forget()
    whole = list(own.texts([text, "x", ""]))
    assert len(own.place) == 2 and whole[2] is None
    assert list(whole[0][0]) == list(apart[0]) and whole[0][1:] == apart[1:]


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(aligned, "CACHE_PARTS", 3)
    monkeypatch.setattr(aligned, "LEARN_CHARS", 5)
    own = aligned.Aligner(*aligned.default_files())
    once = [x[1:] for t in ("a bc def", "bc ghi é") for x in own.texts([t])]
    assert [x[1:] for x in own.texts(["a bc def", "bc ghi é"])] == once


def test_nasty_rows(spark):
    rows = [(i, t) for i, t, _, _ in nasty.ROWS if t is None or len(t) < 1000]
    out = aligned.align(nasty.documents(spark, [r for r in nasty.ROWS if r[1] is None or len(r[1]) < 1000]))
    assert got(out) == brute(rows)
    long = {r.doc_id: r for r in aligned.align(nasty.documents(spark)).collect()}
    assert long[10].n_a > 0 and long[5].n_groups > 30_000 and long[2].n_links == 0
    assert aligned.align(nasty.empty(spark)).count() == 0
