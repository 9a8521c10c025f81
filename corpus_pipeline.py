"""A training corpus from documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import bpe, exact, mixing, quality, simhash
from reviewlake.llm.common import settle, table

WEIGHTS = [3, 1, 2]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the smallest doc_id stays."""
    return exact.distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of texts connected by fingerprints within 3 bits or by similar shingles of five words the smallest doc_id stays."""
    return simhash.without_similar(docs, shingle=5, similarity=0.8, most=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    return mixing.mixture(docs, WEIGHTS, share=1.5, most=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of every document, and digests of them and of the text decoded from them."""
    return bpe.encode_and_decode(docs, bpe.default_tokenizer(), keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("encode", encode),
]

# Trained models and seeded search have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
