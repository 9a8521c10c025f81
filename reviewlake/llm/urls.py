"""Operator 10: URL filters by a weighted vocabulary.

One Aho-Corasick pass over a URL finds all strict and soft terms; a hit counts only between characters that are
no ASCII letters or digits.  One strict hit rejects, and so do several distinct soft ones.  Rules on host and path
go before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import bounded_batches, freeing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The vocabulary and the number of soft terms that reject are parameters; these are their defaults.
STRICT = ("casino", "porn", "porno", "xxx", "hentai", "escort", "escorts", "viagra", "cialis", "jackpot", "warez")
SOFT = (
    "adult", "bet", "betting", "bonus", "cam", "cheap", "click", "crack", "dating", "download", "farm", "free",
    "girls", "loan", "loans", "nude", "pharmacy", "pills", "poker", "serial", "sex", "slots", "spam", "torrent", "win",
)
SOFT_HITS = 2
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(r: Rule) -> Column:
        own = (host == r[1]) | host.endswith(f".{r[1]}")
        return own & path.startswith(r[2])

    def pick(value) -> Column:
        none = F.lit(None).cast("string")
        return reduce(lambda rest, r: F.when(fits(r), F.lit(value(r))).otherwise(rest), reversed(longest), none)

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def count_terms(automaton: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """(strict hits, distinct soft terms) of a lower-cased URL; a term ends where no letter or digit follows."""
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton.iter(url):
        begin = end - len(term) + 1
        if begin and url[begin - 1].isascii() and url[begin - 1].isalnum():
            continue
        if end + 1 < len(url) and url[end + 1].isascii() and url[end + 1].isalnum():
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def build(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term.lower(), (term.lower(), False))
    for term in strict:  # a term in both lists is strict
        automaton.add_word(term.lower(), (term.lower(), True))
    automaton.make_automaton()
    return automaton


def judge(
    pages: DataFrame,
    rules: list[Rule],
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_hits: int = SOFT_HITS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    A NULL or empty URL has empty host and path, no rule and no hits, so it is allowed.  Repeated rows are judged
    each; other columns are not read.  A map without a shuffle; the vocabulary must not be empty.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(strict, soft)
        lower = str.maketrans(UPPER, LOWER)
        for batch in batches:
            found = [count_terms(automaton, (u or "").translate(lower)) for u in batch.column("url").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                names=["page_id", "url", "strict_hits", "soft_hits"],
            )

    counted = rows.mapInArrow(freeing(run), f"page_id {kind}, url string, strict_hits long, soft_hits long").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "strict_hits", "soft_hits"
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits)
    method = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return counted.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "strict_hits", "soft_hits"
    )


def oracle(rules: list[Rule], strict=STRICT, soft=SOFT, soft_hits=SOFT_HITS) -> str:
    """The same judgement in DuckDB's SQL over the table pages."""

    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{r[1] + r[2]}'" for f, r in zip(fits, longest))
    verdict = " ".join(f"WHEN {f} THEN '{r[0]}'" for f, r in zip(fits, longest))
    strict_sum = " + ".join(
        f"len(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda w: w = '{t}'))" for t in strict
    )
    soft_sum = " + ".join(f"{hit(t)}::INT" for t in soft)
    return f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages),
    p AS (SELECT page_id, low,
      translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
      regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
      ({strict_sum})::BIGINT AS strict_hits, ({soft_sum})::BIGINT AS soft_hits FROM u)
    SELECT page_id, host, path, CASE {rule} END AS "rule",
      CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END AS verdict,
      strict_hits, soft_hits FROM p"""
