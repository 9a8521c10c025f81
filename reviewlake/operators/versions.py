"""Compare two versions of a file, over a table of version pairs.

Pairs are rows (pair, left, right).  ``side_by_side`` aligns lines exactly;
``line_delta`` counts lines without regard to their order and needs no Python.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lcs import align
from reviewlake.functions.text import normalise_eol, split_lines

DIFF_ROW = "kind string, left string, right string, left_no bigint, right_no bigint"
_BATCH_ROWS = 20_000
_BATCH_CHARS = 32_000_000


def line_delta(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per pair: lines ``common``, ``removed`` and ``added``, as multisets.

    Both sides are counted per (pair, line) in one map-side combined
    aggregation, so a long file spreads over its lines.
    """

    def tagged(side, in_right):
        return F.transform(
            split_lines(normalise_eol(side)),
            lambda line: F.struct(line.alias("line"), F.lit(in_right).alias("in_right")),
        )

    lines = pairs.select(*keys, F.inline(F.concat(tagged("left", 0), tagged("right", 1))))
    per_line = lines.groupBy(*keys, "line").agg(
        F.count_if(F.col("in_right") == 0).alias("l"), F.count_if(F.col("in_right") == 1).alias("r")
    )
    common = F.least("l", "r")
    return per_line.groupBy(*keys).agg(
        F.sum(common).alias("common"),
        F.sum(F.col("l") - common).alias("removed"),
        F.sum(F.col("r") - common).alias("added"),
    )


def _aligned_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, n_keys: int):
    columns = [[] for _ in schema]
    chars = 0

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )
        for c in columns:
            c.clear()
        return batch

    for batch in batches:
        for i in range(batch.num_rows):
            keys = [batch.column(k)[i].as_py() for k in range(n_keys)]
            left = batch.column(n_keys)[i].as_py().split("\n")
            right = batch.column(n_keys + 1)[i].as_py().split("\n")
            for pos, (same, a, b) in enumerate(align(left, right)):
                row = (
                    *keys,
                    pos,
                    "same" if same else "changed",
                    None if a is None else left[a],
                    None if b is None else right[b],
                    None if a is None else a + 1,
                    None if b is None else b + 1,
                )
                for c, value in zip(columns, row):
                    c.append(value)
                chars += len(row[-4] or "") + len(row[-3] or "")
                if len(columns[0]) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield flush()
                    chars = 0
    if columns[0]:
        yield flush()


def _prepared(pairs: DataFrame, *keys: str) -> DataFrame:
    """Both sides with one kind of line end; pairs that lack a side are left out."""
    sides = pairs.select(*keys, normalise_eol("left").alias("left"), normalise_eol("right").alias("right"))
    return sides.filter(F.col("left").isNotNull() & F.col("right").isNotNull())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (l, r, left, right) to l, r and how many aligned rows are of each kind."""
    names = ["l", "r", "same", "changed", "left_only", "right_only"]
    for batch in batches:
        columns: list[list[int]] = [[], [], [], []]
        for left, right in zip(batch.column("left"), batch.column("right")):
            counts = [0, 0, 0, 0]
            for same, a, b in align(left.as_py().split("\n"), right.as_py().split("\n")):
                counts[0 if same else 2 if b is None else 3 if a is None else 1] += 1
            for column, n in zip(columns, counts):
                column.append(n)
        yield pa.record_batch([batch.column("l"), batch.column("r"), *(pa.array(c, pa.int64()) for c in columns)], names=names)


def pair_stats(pairs: DataFrame, *keys: str) -> DataFrame:
    """``diff_stats`` of ``side_by_side`` for every pair, without its rows: only counts leave the alignment.

    Sides are named by their content; a pair of texts that several pairs have is brought together by an aggregation and
    aligned once.  The keys alone meet its counts again, repeated ones too.
    """
    named = _prepared(pairs, *keys).withColumns({"l": F.sha2("left", 256), "r": F.sha2("right", 256)})
    texts = named.groupBy("l", "r").agg(F.any_value("left").alias("left"), F.any_value("right").alias("right"))
    kinds = ", ".join(f"{n} bigint" for n in ("same", "changed", "left_only", "right_only"))
    stats = texts.mapInArrow(_counted, f"l string, r string, {kinds}")
    return named.select(*keys, "l", "r").join(stats, ["l", "r"]).drop("l", "r")


def side_by_side(pairs: DataFrame, *keys: str) -> DataFrame:
    """Aligned rows of every pair: ``pos``, ``kind``, both lines and their numbers.

    Pairs are independent rows.  An alignment costs the product of its lines while
    partitions are sized by bytes, so the pairs are dealt out evenly first.
    The kernel handles files of any length in bounded memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared = _prepared(pairs, *keys)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = prepared.repartition(parts, F.xxhash64(*keys) if keys else F.rand(1))
    key_ddl = ", ".join(f"`{k}` {prepared.schema[k].dataType.simpleString()}" for k in keys)
    ddl = ", ".join(p for p in (key_ddl, "pos bigint", DIFF_ROW) if p)
    arrow = to_arrow_schema(pairs.sparkSession.createDataFrame([], ddl).schema)
    n_keys = len(keys)
    return prepared.mapInArrow(lambda batches: _aligned_batches(batches, arrow, n_keys), ddl)


def diff_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of the row kinds per pair."""
    changed = F.col("kind") == "changed"
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "same").alias("same"),
        F.count_if(changed & F.col("left_no").isNotNull() & F.col("right_no").isNotNull()).alias("changed"),
        F.count_if(changed & F.col("right_no").isNull()).alias("left_only"),
        F.count_if(changed & F.col("left_no").isNull()).alias("right_only"),
    )


def change_share(stats: DataFrame, *keys: str) -> DataFrame:
    """Share of rows that differ, in parts per million, over all pairs of a group."""
    differing = F.sum(F.col("changed") + F.col("left_only") + F.col("right_only"))
    rows = F.sum(F.col("same") + F.col("changed") + F.col("left_only") + F.col("right_only"))
    return stats.groupBy(*keys).agg(
        rows.alias("rows"),
        differing.alias("differing"),
        F.floor(differing * 1_000_000 / rows).cast("bigint").alias("ppm"),
    )
