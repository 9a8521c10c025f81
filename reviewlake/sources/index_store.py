"""The report index in ranges of ids: publishing rewrites the ranges it touches and no others."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.operators.index import upsert_index
from reviewlake.session import settle
from reviewlake.sources import commits
from reviewlake.sources.commits import Commit, Part

# Entries of a range; one of more than twice as many is split when it is written.
PER_RANGE = 50_000
ATTEMPTS = 20
_PIECES = 1 << 32


class Taken(RuntimeError):
    """Another publisher was faster."""


def collated(id_: str = "id") -> Column:
    return F.collate(F.col(id_), "UNICODE")


def range_of(firsts: list[str], id_: str = "id") -> Column:
    """The number of the range an id belongs to, 0 below the first border; borders are in order.

    Borders are looked up in groups of the square root of their number, in one constant expression.
    """
    if not firsts:
        return F.lit(0)
    width = math.isqrt(len(firsts) - 1) + 1
    groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    borders = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")
    key = collated(id_)

    def below(border: Column) -> Column:
        theirs = F.collate(border, "UNICODE")
        return (theirs < key) | ((theirs == key) & (border <= F.col(id_)))

    group = F.size(F.filter(borders, lambda g: below(g[0])))
    inside = F.size(F.filter(F.get(borders, group - 1), below))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def read_parts(spark: SparkSession, path: str, parts: list[Part]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], S.INDEX_ENTRY)
    return spark.read.schema(S.INDEX_ENTRY).json([f"{path}/{p.folder}" for p in parts])


def _written(entries: DataFrame, path: str, per_range: int) -> dict[int, list[Part]]:
    """Write entries (with `range`) in order, a folder per range, or several for a large one; the parts of each range."""
    spark = entries.sparkSession
    sizes = {r["range"]: r["n"] for r in entries.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row per range
    large = [r for r, n in sizes.items() if n > 2 * per_range]
    tasks = sum(max(1, -(-n // per_range)) for n in sizes.values())
    order = ["range", collated(), F.col("id")]
    dealt = entries.repartitionByRange(max(1, tasks), *order)
    # Not a constant even where all is one folder: Spark would drop a sort by constants, and write in another order.
    task = F.spark_partition_id()
    piece = F.when(F.col("range").isin(large), task).otherwise(F.least(task, F.lit(0)))
    folder = f"data-{uuid.uuid4().hex}"
    rows = dealt.withColumn("part", F.col("range").cast("long") * _PIECES + piece).drop("range")
    rows = rows.sortWithinPartitions("part", collated(), "id")
    rows.write.option("ignoreNullFields", "false").partitionBy("part").json(f"{path}/{folder}")
    if not sizes:
        return {}
    back = spark.read.schema(f"{S.INDEX_ENTRY}, part long").json(f"{path}/{folder}")
    found = back.groupBy("part").agg(
        F.count("*").alias("n"), F.min_by("id", F.struct(collated(), "id")).alias("first"), F.min(F.struct(collated().alias("c"), "id")).alias("least")
    )
    found = found.withColumn("range", F.floor(F.col("part") / _PIECES))
    parts: dict[int, list[Part]] = {}
    for r in found.orderBy("range", "least").collect():  # one row per written folder
        parts.setdefault(r["range"], []).append(Part(f"{folder}/part={r['part']}", r["n"], r["first"]))
    return parts


def _merged(entries: DataFrame, now: Commit, path: str, firsts: list[str], order: tuple[str, ...], per_range: int) -> dict[int, list[Part]]:
    """Write the ranges that get entries, with them; the new parts of each."""
    placed = entries.select(range_of(firsts).alias("range")).distinct()
    touched = sorted(r[0] for r in placed.collect())  # ranges, not entries
    old = read_parts(entries.sparkSession, path, [now.parts[i] for i in touched if i < len(now.parts)])
    merged = upsert_index(old, entries.select(*old.columns), *order).withColumn("range", range_of(firsts))
    # Counted, dealt out and written: merged and placed once for all three.
    staged = f"{path}/data-{uuid.uuid4().hex}"
    try:
        return _written(settle(merged, staged), path, per_range)
    finally:
        place, files = commits.place_of(entries.sparkSession, staged)
        files.delete(place, True)


def replace_index(index: DataFrame, path: str, per_range: int = PER_RANGE) -> int:
    """The whole index anew.  Of two writers that started from one version the second fails and changes nothing."""
    spark = index.sparkSession
    now = commits.latest(spark, path)
    own = index.select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in S.INDEX_ENTRY.split(", "))])
    parts = _written(own.withColumn("range", F.lit(0)), path, per_range).get(0, [])
    parts = [p._replace(first=p.first if i else None) for i, p in enumerate(parts)]
    new = Commit(now.version + 1, parts, now.done)
    if not commits.commit(spark, path, new):
        raise Taken(f"version {new.version} of {path} was written by another publisher")
    commits.clean(spark, path)
    return new.version


def publish_index(
    entries: DataFrame, path: str, *order: str, per_range: int = PER_RANGE, writer: str | None = None, batch: int | None = None
) -> int:
    """Add entries or replace those with the same id, and give the version they are in.

    Of several new entries with one id the last by ``order`` wins.  Only the ranges that get entries are read and
    written, beside the old ones; the commit comes last, and a publisher that finds its number taken starts again from
    the commit that took it, so of several publishers at once none loses an entry.  With ``writer`` and ``batch``, a
    batch that the writer has published is not published again.  ``entries`` are read again on each attempt.
    """
    spark = entries.sparkSession
    for _ in range(ATTEMPTS):
        now = commits.latest(spark, path)
        if writer is not None and now.done.get(writer, -1) >= batch:
            return now.version
        firsts = [p.first for p in now.parts[1:]]
        try:
            written = _merged(entries, now, path, firsts, order, per_range)
        except Exception:
            if commits.latest(spark, path).version > now.version:
                continue  # what was read is gone, others have published meanwhile
            raise
        parts: list[Part] = []
        for i in range(max(len(now.parts), 1)):
            new = written.get(i, [])
            # A range keeps its border, whatever is the first entry in it now.
            border = now.parts[i].first if i < len(now.parts) else None
            parts += [p._replace(first=p.first if k else border) for k, p in enumerate(new)] or now.parts[i : i + 1]
        done = now.done | ({writer: batch} if writer is not None else {})
        if commits.commit(spark, path, Commit(now.version + 1, parts, done)):
            commits.clean(spark, path)
            return now.version + 1
    raise Taken(f"{path}: other publishers were faster {ATTEMPTS} times")
