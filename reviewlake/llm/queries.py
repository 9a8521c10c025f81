"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import aligned, bpe, exact, flac, hpylm, lines, mixing, quality, ranked, repeats, simhash, toxicity, urls
from reviewlake.llm.common import table

MIX_WEIGHTS = [3, 1, 2]
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), bpe.default_tokenizer())


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, most=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.store_and_read(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_hpylm, op3_exact_dedup, op4_simhash, op5_mixing, op6_line_dedup, op7_quality, op8_toxicity, op9_flac, op10_url_filter, op11_repeats, op12_ranked_search, op13_token_alignment)}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact.ORACLE,
    "op5_mixing": mixing.oracle(MIX_WEIGHTS),
    "op10_url_filter": urls.oracle(URL_RULES),
    "op12_ranked_search": ranked.oracle(),
}
