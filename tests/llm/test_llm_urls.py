"""URL filters."""

import random
import re

from reviewlake.llm import urls
from reviewlake.llm.queries import URL_RULES

URLS = [
    (1, "https://Casino-Win.example.com/x"), (2, "http://mycasino.example.net/"), (3, None), (4, ""), (5, "no scheme"),
    (6, "HTTP://WWW.Example.ORG/es/1?q#f"), (7, "http://example.org/en/1"), (8, "http://a.example.org/en/12"),
    (9, "http://notexample.org/en/1"), (10, "http://org"), (11, "http://x.com/fr/1"), (12, "http://x.com/de/1"),
    (13, "http://spam-farm.example.net/"), (14, "http://spam-spam.example.net/"), (15, "ftp://h?x://y/z"), (16, "://h/p#x"),
    (17, "http://x.net/free_Poker"), (18, "http://x.net/éfree/win"), (19, "a" * 100_000 + "://" + "b" * 100_000 + "/xxx"), (1, "http://again.net/"),
]


def brute(url):
    url = url or ""
    low = "".join(c.lower() if c.isascii() else c for c in url)
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        tail = rest[len(host) :]
        path = re.split(r"[?#]", tail)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    words = re.split(r"[^a-z0-9]+", low)
    strict = sum(words.count(t) for t in urls.STRICT)
    soft = len(set(words) & set(urls.SOFT))
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0], strict, soft
    return host, path, None, "block" if strict or soft >= 2 else "allow", strict, soft


def test_judgements(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in URLS], "page_id long, url string, host string, soft_hits int")
    got = sorted((tuple(r) for r in urls.judge(df, URL_RULES).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in URLS), key=str)
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_random_urls(spark):
    rng = random.Random(5)
    parts = ["casino", "free", "win", "spam", "-", ".", "/", "?", "#", "://", "http", "org", "com", "example", "/fr/", "/de/", "xx", "x", "A", "é", "1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(1500)]
    got = sorted(tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).select("page_id", "host", "path", "verdict", "strict_hits", "soft_hits").collect())
    assert got == [(i, b[0], b[1], b[3], b[4], b[5]) for i, b in ((i, brute(u)) for i, u in rows)]
