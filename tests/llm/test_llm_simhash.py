"""SimHash and its search against brute force."""

import random

import nasty
import pytest
import xxhash

from reviewlake.llm import simhash
from reviewlake.llm.common import components, settle


def naive(text, k=3):
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, reach):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(values)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= reach:
                parent[find(a)] = find(b)
    return {v: find(v) for v in items}


def check(df, rows):
    prints = {(i, t): naive(t) for i, t in rows}
    of = groups(set(prints.values()), 3)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())
    assert got == sorted((str(i), f"{prints[i, t]:016x}", least.get(of[prints[i, t]])) for i, t in rows)


def test_nasty_rows(spark):
    rows = [(i, t) for i, t, _, _ in nasty.ROWS]
    check(simhash.near_duplicates(nasty.documents(spark)), rows)
    assert simhash.near_duplicates(nasty.empty(spark)).count() == 0


def test_chains_of_edits(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(250)]
        for copy in range(8):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(250)] = f"new{base}x{copy}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(simhash.near_duplicates(df), rows)


@pytest.mark.parametrize("most, parts", [(3, 2), (3, 3), (3, 4), (3, 5), (0, 2), (5, 4), (3, None)])
def test_links_are_all_pairs_in_reach(spark, most, parts):
    """Whatever the partitions and thresholds, no pair is lost; dense and skewed bits too."""
    rng = random.Random(most)
    values = {rng.getrandbits(64) & 0xFFFF0F0F0F0F00FF for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, most, parts).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= most}
    assert got == want


def test_similar_groups(spark):
    """Texts with a fiftieth of their words changed meet; unrelated ones and short ones do not."""
    rng = random.Random(9)
    rows, of = [], {}
    for base in range(30):
        words = [f"v{rng.randrange(3000)}" for _ in range(300)]
        for copy in range(4):
            changed = list(words)
            for at in rng.sample(range(300), 5) if copy else ():
                changed[at] = f"c{base}x{copy}x{at}"
            of[len(rows)] = base
            rows.append((len(rows), " ".join(changed)))
    rows += [(1000 + i, f"short text {i}") for i in range(20)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {r.doc_id: r.root for r in simhash.similar_groups(df).collect()}
    assert len(set(roots.values())) == 30 + 20 + 1
    assert all((roots[a] == roots[b]) == (of[a] == of[b]) for a in of for b in of)
    kept = {r.doc_id for r in simhash.without_similar(df).collect()}
    assert kept == {base * 4 for base in range(30)} | {1000 + i for i in range(20)} | {2000}
    assert simhash.without_similar(nasty.empty(spark)).count() == 0


def brute_force(spark, texts):
    """Pairs of texts whose five-word shingles have a similarity of at least 0.8, and the root of each text found."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    holds = {}
    for i, s in enumerate(sets):
        for v in s:
            holds.setdefault(v, []).append(i)
    pairs = {(i, j) for of in holds.values() for j in of for i in of if i < j}
    pairs = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pairs, {r.doc_id: r.root for r in simhash.similar_groups(df).collect()}


@pytest.mark.parametrize("zipf", [False, True])
def test_recall_at_the_threshold(spark, zipf):
    """Text appended, cut off or edited here and there, short and long: 99 % of all pairs of 0.8 and more are found."""
    rng = random.Random(13 + zipf)
    draw = lambda: f"w{int(rng.paretovariate(1)) % 20000 if zipf else rng.randrange(20000)}"
    texts = []
    for n in (50, 100, 200, 400, 700, 1000):
        for kind in range(3):
            for _ in range(25):
                words = [draw() for _ in range(n)]
                texts.append(" ".join(words))
                part = int(n * rng.uniform(0.12, 0.23))
                if kind == 0:
                    words += [draw() for _ in range(part)]
                elif kind == 1:
                    words = words[: n - int(0.8 * part)]
                else:
                    for at in rng.sample(range(n), max(1, n // 50)):
                        words[at] = draw()
                texts.append(" ".join(words))
    pairs, roots = brute_force(spark, texts)
    assert len(pairs) > 350
    assert sum(roots[i] == roots[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all((i, j) in pairs for i, j in zip(range(0, len(texts), 2), range(1, len(texts), 2)) if roots[i] == roots[j])


def test_members_at_rest_are_met(spark):
    """A row that is similar only to one in the middle of its bucket, linked to another already, is linked as well."""
    alike = {(1, i) for i in (2, 3, 4, 5, 6)} | {(3, 9)}
    # The row that shares most keys leads.
    for first in (1, 9):
        rows = [(i, [7, 100 + i, 200 + i] if i != first else [7, 8, 9], [0] * simhash.WORDS) for i in (1, 2, 3, 4, 5, 6, 9)]
        rows += [(50 + first, [8, 9], [-1] * simhash.WORDS)]
        marked = settle(spark.createDataFrame(rows, "id long, keys array<long>, bits array<long>"))
        pairs = spark.createDataFrame(list(alike), "x long, y long")
        links = simhash._links(marked, lambda p: settle(p.join(pairs, ["x", "y"])), simhash.most_differing(0.8))
        of = {r.node: r.root for r in components(links, "x", "y").collect()}
        assert of == {i: 1 for i in (1, 2, 3, 4, 5, 6, 9)}


def test_recall_in_mixed_keys(spark):
    """Families of edits of edits whose members are often below 0.8 to each other, beside texts that share a long passage."""
    rng = random.Random(17)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base = draw(120)
        for _ in range(40):
            words = list(base if rng.random() < 0.5 else texts[-1].split())
            for at in rng.sample(range(len(words)), rng.randint(1, 5)):
                words[at] = draw(1)[0]
            texts.append(" ".join(words))
    passage = draw(100)
    texts += [" ".join(passage + draw(rng.randint(5, 60))) for _ in range(150)]
    pairs, roots = brute_force(spark, texts)
    assert len(pairs) > 500
    assert sum(roots[i] == roots[j] for i, j in pairs) >= 0.99 * len(pairs)
    of = {}
    for i, j in pairs:
        of.setdefault(i, set()).add(j)
        of.setdefault(j, set()).add(i)
    # No group holds more than what brute force connects.
    seen = {}
    for i in range(len(texts)):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen[k] = i
                stack += of.get(k, ())
    assert all(seen[i] == seen[j] for i in roots for j in [next(k for k in roots if roots[k] == roots[i])])


def test_near_dedup_of_nasty_rows(spark):
    """Clashing columns, repeated rows, very long texts, NULL ids and texts: one row of each group stays, whole."""
    docs = nasty.documents(spark)
    kept = simhash.without_similar(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # Without words (2, 3, 4), the long texts (5, 6), the short copies (7, 8 and a NULL id), `one` (11, 12).
    assert sorted((i for i, _ in rows), key=repr) == [1, 10, 11, 2, 5, 7, 9]


def test_same_words_in_other_orders(spark):
    """Families of one set of words in other orders, interleaved: each family is one group and stays apart from the others."""
    rng = random.Random(21)
    words, families = [f"w{i}" for i in range(200)], []
    for _ in range(6):
        rng.shuffle(words)
        families.append(list(words))
    texts = []
    for copy in range(5):
        for f in families:
            changed = list(f)
            at = 30 * copy + 10
            changed[at : at + 3] = changed[at : at + 3][::-1]
            texts.append(" ".join(changed))
    pairs, roots = brute_force(spark, texts)
    assert len(pairs) == 6 * 10
    assert all(roots[i] == roots[i % 6] for i in roots) and len(set(roots.values())) == 6


def test_near_fingerprints_connect_in_the_pipelines_stage(spark):
    """What operator 4 links goes, though few shingles of five words are common; without `most` it stays."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(40)}" for _ in range(900)]
    base, rows = " ".join(words), []
    # Edits dealt out evenly break many shingles of five words; of some such texts the fingerprints are near.
    for i in range(400):
        changed = list(words)
        for at in range(rng.randrange(18), 900, 18):
            changed[at] = f"w{rng.randrange(40)}"
        rows.append((i + 1, " ".join(changed)))
    base_print, base_set = naive(base), {tuple(words[i : i + 5]) for i in range(896)}

    def similarity(text):
        w = text.split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return len(own & base_set) / len(own | base_set)

    i, text = next((i, t) for i, t in rows if (naive(t) ^ base_print).bit_count() <= 3 and similarity(t) < 0.75)
    df = spark.createDataFrame([(0, base), (i, text), (1000, "apart")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.without_similar(df).collect()} == {0, i, 1000}
    assert {r.doc_id for r in simhash.without_similar(df, most=3).collect()} == {0, 1000}


def test_last_comparison_makes_rows_of_links_only(spark):
    """Many rows of one key that are unlike by exact sets, though their fingerprints are alike: one link is one row."""
    n = 300
    rows = [(i, [7, i + 100], [0] * simhash.WORDS, [i * 10 + k for k in range(10)]) for i in range(n)]
    rows += [(n, [7, 8], [0] * simhash.WORDS, [*range(9), -1])]  # as row 0 but for one element
    df = settle(spark.createDataFrame(rows, "id long, keys array<long>, bits array<long>, s array<long>"))
    mixed = settle(df.selectExpr("7L AS key", "id", "id AS root", "id > 0 AS beside"))
    met = simhash._met_in_join(mixed, df.drop("s"), lambda ids: settle(df.select("id", "s")), simhash._alike("s", "of_s", 0.8), 40)
    assert [tuple(r) for r in met.collect()] == [(0, n)]
