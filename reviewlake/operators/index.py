"""The report index: one entry per report, replaced as a whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_index(index: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Replace or add entries by ``id``.

    Of several new entries with one id the last by ``order`` wins.  Old and new
    go through one map-side combined aggregation, so a frequent id costs no
    more than any other.
    """
    rank = [F.col(c) for c in order]
    both = index.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    value = F.struct(*[c for c in index.columns if c != "id"])
    latest = both.groupBy("id").agg(F.max_by(value, F.struct("_new", *rank)).alias("_row"))
    return latest.select(
        *[F.col("id") if c == "id" else F.col(f"_row.{c}").alias(c) for c in index.columns]
    )


def sort_index(index: DataFrame) -> DataFrame:
    """Ordered by id the way people sort words, not by code point."""
    return index.orderBy(F.collate("id", "UNICODE"), "id")
