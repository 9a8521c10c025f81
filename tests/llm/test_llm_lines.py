"""Fuzzy lines against all pairs."""

import random

import nasty
from pyspark.sql import functions as F

from reviewlake.llm import lines
from reviewlake.llm.common import bucket_links


def characters(line):
    return frozenset(line[i : i + lines.SIZE] for i in range(max(1, len(line) - lines.SIZE + 1)))


def all_lines(rows):
    out = []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            norm = line.strip(" \t\r\x0b\x0c").lower()
            if norm:
                out.append((i, n, norm))
    return out


def test_nasty_rows(spark):
    rows = lines.deduplicate(nasty.documents(spark)).collect()
    want = all_lines([(i, t) for i, t, _, _ in nasty.ROWS])
    assert sorted((str(r.doc_id), r.line_no) for r in rows) == sorted((str(i), n) for i, n, _ in want)
    kept = {(r.doc_id, r.line_no) for r in rows if r.kept}
    assert (1, 1) in kept and (1, 3) not in kept  # the second of two equal lines goes
    assert sum(r.kept for r in rows if r.doc_id == 7) == 1 and (11, 0) in kept and (12, 0) not in kept
    cleaned = {r.doc_id: r.text for r in lines.clean(nasty.documents(spark)).collect()}
    assert cleaned[1] == "Hello World, it's me: Thing-1 thing-2!\nLine two of it.\n"
    assert cleaned[2] == cleaned[3] == "" and cleaned[12] == ""
    assert lines.deduplicate(nasty.empty(spark)).count() == 0


def test_recall_and_no_false_links(spark):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        base = [f"tok{rng.randrange(400)}" for _ in range(40)]
        copies = []
        for _ in range(5):
            line = list(base)
            if rng.random() < 0.8:
                line[rng.randrange(40)] = f"edit{rng.randrange(10**6)}"
            copies.append(" ".join(line))
        docs.append((i, "\n".join(copies)))
    docs.append((99, "\n".join(" ".join(f"other{rng.randrange(10**6)}" for _ in range(30)) for _ in range(50))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in lines.deduplicate(df).collect()}
    rows = [(i, n, characters(x)) for i, n, x in all_lines(docs)]
    parent = {(i, n): (i, n) for i, n, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = found = 0
    for k, (i, n, a) in enumerate(rows):
        for j, m, b in rows[:k]:
            if len(a & b) >= lines.SIMILARITY * len(a | b):
                links += 1
                found += root[i, n] == root[j, m]
                parent[find((i, n))] = find((j, m))
    assert links > 200 and found >= 0.99 * links
    assert all(find(k) == find(v) for k, v in root.items())  # nothing meets that is not connected


def test_main_path_is_native(spark):
    df = lines.candidates(lines.signatures(lines.split_lines(nasty.documents(spark).select("doc_id", "text")), lines.SIZE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def found_links(spark, texts):
    """Of lines of one document: pairs alike by brute-force character shingles, and those in one component."""
    df = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    root = {r.line_no: r.keep_line_no for r in lines.deduplicate(df).collect()}
    sets = [characters(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= lines.SIMILARITY * len(a | b)]
    return links, [(i, j) for i, j in links if root[i] == root[j]], root


def test_spaceless_lines_and_long_words(spark):
    """Characters after the ninth of a word count: different lines stay, near copies of lines without spaces go."""
    rng = random.Random(7)
    texts = ["internationalization", "internationally", "2024年のレポートは成功しました。", "2024年のレポートは失敗に終わった。"]
    texts += [f"https://www.example.org/{rng.randrange(10**12)}/{rng.randrange(10**12)}" for _ in range(40)]
    texts += ["start " + " ".join(f"{w}{rng.randrange(10**9):09}" for w in ("resource", "identity", "location", "document")) for _ in range(20)]
    apart = len(texts)
    for i in range(30):
        base = [rng.choice("日本語の文章でありますから長い行を作るとき使用する文字😀") for _ in range(120)]
        texts.append("".join(base))
        base[rng.randrange(5, 115)] = "x"
        texts.append("".join(base))
    links, found, root = found_links(spark, texts)
    assert len(links) == 30 and found == links
    assert all(root[i] == i for i in range(apart))


def test_lines_that_differ_in_a_long_word_stay(spark):
    """Ten long words of which one differs: 0.75 by characters at the most, however many words are alike."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=17))
    texts = []
    for _ in range(30):
        words = [word() for _ in range(10)]
        texts.append(" ".join(words))
        words[rng.randrange(1, 9)] = word()
        texts.append(" ".join(words))
    links, _, root = found_links(spark, texts)
    assert not links and all(root[i] == i for i in root)


def test_recall_of_short_lines(spark):
    """Lines of 4 to 12 shingles: the bands miss no more pairs than independent hashes do (0.3 % at a similarity of 0.8)."""
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(lines.SIZE + 3 + i % 8))
        rows += [(2 * i, line), (2 * i + 1, line + "z")]
    assert all(len(characters(a) & characters(b)) >= lines.SIMILARITY * len(characters(a) | characters(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep = {r.doc_id: r.keep_doc_id for r in lines.deduplicate(df).collect()}
    assert sum(keep[2 * i + 1] == keep[2 * i] for i in range(1500)) >= 0.995 * 1500


def test_lines_at_rest_are_met(spark):
    """3 and 9 are alike; 3 is linked to the first line before 9 has met it."""
    alike = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (3, 9)]
    pairs = spark.createDataFrame(alike, "x long, y long")
    rows = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4, 5, 6, 9)], "band long, id long")
    links = {(r.x, r.y) for r in bucket_links(rows, lambda p: p.join(pairs, ["x", "y"])).collect()}
    assert links == set(alike)


def test_mixed_hot_bucket(spark):
    """25 families of 8 interleaved in one bucket: every row meets its family, without all pairs being made."""
    rows = [(7, f"{copy}{family:02}") for family in range(25) for copy in range(8)] + [(8, "000"), (9, "001"), (9, "103")]
    checked = []

    def of_a_family(pairs):
        checked.append(pairs.count())
        return pairs.filter("right(x, 2) = right(y, 2)")

    df = spark.createDataFrame(rows, "band long, id string")
    marks = df.select("id", F.right("id", F.lit(2)).alias("mark")).distinct()
    found = bucket_links(df, of_a_family, marks, lambda x, y: F.col(x) == F.col(y))
    links = {(r.x, r.y) for r in found.collect()}
    parent = {i: i for _, i in rows}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in links:
        parent[find(x)] = find(y)
    assert len({find(v) for v in parent}) == 25
    assert sum(checked) < 200 * 199 / 2 / 2


def test_lines_alone_in_their_buckets_are_not_compared(spark, monkeypatch):
    """The comparison reads texts of lines that share a bucket, not those of the whole table."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(200)]
    texts.append(texts[0] + "z")
    read, plain = [], lines.verified

    def counted(pairs, table, size, similarity):
        read.append(table.count())
        return plain(pairs, table, size, similarity)

    monkeypatch.setattr(lines, "verified", counted)
    links, found, _ = found_links(spark, texts)
    assert links == found == [(200, 0)]
    assert max(read) == 2


def test_no_pair_is_verified_twice(spark):
    """Rows that meet in several buckets and rounds are compared once; those linked in an earlier round count as linked."""
    rows = spark.createDataFrame([(band, i) for band in (7, 8) for i in range(12 - band, 12)], "band long, id long")
    seen = []

    def halves(pairs):
        seen.extend((r.x, r.y) for r in pairs.collect())
        return pairs.filter("x % 3 = y % 3")

    links = {(r.x, r.y) for r in bucket_links(rows, halves).collect()}
    assert len(seen) == len(set(seen))
    assert {(4, 7), (5, 8), (6, 9)} <= links and all(x % 3 == y % 3 for x, y in links)


def test_lines_with_a_common_passage_do_not_meet_pair_by_pair(spark, monkeypatch):
    """50 lines of one passage and 40 characters of their own (0.69 alike) share buckets; near copies among them are found."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(220)
    texts = [passage + letters(40) for _ in range(50)]
    texts += [t[:-5] + letters(5) for t in texts[:10]]
    asked, plain = [], lines.verified

    def counted(pairs, table, size, similarity):
        asked.append(pairs.count())
        return plain(pairs, table, size, similarity)

    monkeypatch.setattr(lines, "verified", counted)
    links, found, root = found_links(spark, texts)
    assert links == found == [(50 + i, i) for i in range(10)]
    assert all(root[i] == i for i in range(50))
    assert sum(asked) < 3 * len(texts)
