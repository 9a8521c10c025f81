"""Operator 3: exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of a fixed size.  Sorting all blocks gives equal ones the same whole number,
their name; then adjacent names are paired and the pairs sorted and named again, until every document has one name.
Names stand for contents, not for digests of them, so they cannot collide.

A sort is a range partitioning with the row as the last key: a block that very many rows share spreads over
partitions.  Each partition numbers its runs of equal blocks; prefix sums over the partitions, less one where a run
goes on across a border, make the numbers global.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlake.llm.common import bounded_batches, freeing, id_and_text, matching, numbered, settle, slices

BLOCK = 8192
# So many first bytes of a block are in the short key that rows are dealt out by.
HEAD = 32
_SPACE = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    """Each run of white space is one space, at the ends too."""
    body = b" ".join(text.split())  # of bytes: white space of ASCII
    if not body:
        return b" " if text else b""
    return b" " * (text[0] in _SPACE) + body + b" " * (text[-1] in _SPACE)


def cut(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, pos, n, block, sha (with the first block only) of every document; an empty text is one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        names = ["row", "doc_id", "pos", "n", "block", "sha"]
        for batch in batches:
            rows, keys = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                out = []
                for i, text in enumerate(map(normalised, texts), first):
                    n = max(1, -(-len(text) // size))
                    sha = hashlib.sha256(text).digest()
                    for pos in range(n):
                        block = text[pos * size : (pos + 1) * size]
                        out.append((rows[i], keys[i], pos, n, block, None if pos else sha))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(freeing(run), "row long, doc_id long, pos int, n int, block binary, sha binary")


def named(df: DataFrame, *key: str) -> DataFrame:
    """df with the columns of `key`, not NULL, replaced by `name`: equal keys have equal numbers, others do not.

    Rows are dealt out by a short key, the first bytes of a block and a hash, so that the borders of the partitions
    are short too; within a partition whole contents are compared.  Should two contents ever share a
    short key, rows are dealt out by whole contents instead.
    """
    head = F.substring(key[0], 1, HEAD) if dict(df.dtypes)[key[0]] == "binary" else F.col(key[0])
    short = df.withColumns({"_head": head, "_hash": F.xxhash64(*key)})
    done = _numbered(short, key, ["_head", "_hash"])
    if done.filter("mixed > 0").head(1):
        done = _numbered(short, key, list(key))
    return _global(done, [c for c in df.columns if c not in key])


def _numbered(df: DataFrame, key: tuple[str, ...], by: list[str]) -> DataFrame:
    """The rows with `part` and, within it, `local`, the number of the run of equal keys; and a row on each partition.

    That row has its number of runs, whether its first run goes on from the partition before, and
    how many runs of different contents share a short key with the run before them.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in (*key, "_head", "_hash")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = [*by, *(k for k in key if k not in by), "row", "pos"]
    ordered = df.repartitionByRange(parts, *by, "row", "pos").sortWithinPartitions(*inner)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    compared = [*key, "_hash"]
    edges = [f"{side}_{c}" for side in ("first", "last") for c in compared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = kinds = None
        runs, mixed = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.schema
            differ = None
            for c in key:
                column = batch.column(c)
                changed = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                differ = changed if differ is None else pc.or_(differ, changed)
            hashes = batch.column("_hash")
            same_hash = pc.equal(hashes.slice(1), hashes.slice(0, len(hashes) - 1))
            mixed += pc.sum(pc.and_(differ, same_hash).cast(pa.int64())).as_py() or 0
            now = [batch.column(c)[0].as_py() for c in compared]
            begins = last is None or now[:-1] != last[:-1]
            mixed += last is not None and begins and now[-1] == last[-1]
            steps = pa.concat_arrays([pa.array([begins]), differ]).cast(pa.int64())
            local = pc.add(pc.cumulative_sum(steps), runs)
            runs = local[-1].as_py()
            first = first or now
            last = [batch.column(c)[-1].as_py() for c in compared]
            none = [pa.nulls(len(local), kinds.field(c).type) for c in [*compared, *compared]]
            number = pa.array([part] * len(local), pa.int32())
            blank = pa.nulls(len(local), pa.int64())
            columns = [*(batch.column(c) for c in keep), number, local, blank, blank, *none]
            yield pa.record_batch(columns, names=names)
        if kinds is not None:  # one row on the partition itself
            types = [*(kinds.field(c).type for c in keep), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            types += [kinds.field(c).type for c in [*compared, *compared]]
            values = [*(None for _ in keep), part, None, runs + 1, mixed, *first, *last]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)

    schema = [f"{c} {fields[c]}" for c in keep] + ["part int", "local long", "runs long", "mixed long"]
    schema += [f"{e} {fields[e.split('_', 1)[1]]}" for e in edges]
    names = [c.split(" ")[0] for c in schema]
    done = settle(ordered.mapInArrow(freeing(run), ", ".join(schema)))
    # One row for each partition: a run crosses a border where a first key equals the last one before it.
    before = Window.orderBy("part")
    equal = F.lit(True)
    for c in key:
        equal = equal & (F.col(f"first_{c}") == F.lag(f"last_{c}").over(before))
    alike = F.coalesce(F.col("first__hash") == F.lag("last__hash").over(before), F.lit(False))
    borders = done.filter("runs IS NOT NULL").withColumns({"joined": F.coalesce(equal, F.lit(False)), "alike": alike})
    borders = borders.select("part", "runs", "joined", (F.col("mixed") + (F.col("alike") & ~F.col("joined")).cast("long")).alias("mixed"))
    rows = done.filter("runs IS NULL").drop("runs", "mixed", *edges)
    return rows.unionByName(borders, allowMissingColumns=True)


def _global(done: DataFrame, keep: list[str]) -> DataFrame:
    """Local numbers made global by sums over the partitions; as many rows pass the driver as there are partitions."""
    base, total = [], 0
    for r in done.filter("runs IS NOT NULL").select("part", "runs", "joined").orderBy("part").collect():
        base.append((r.part, total - r.joined))
        total += r.runs - r.joined
    bases = done.sparkSession.createDataFrame(base, "part int, base long")
    rows = done.filter("runs IS NULL").join(F.broadcast(bases), "part")
    return rows.select(*keep, (F.col("base") + F.col("local")).alias("name"))


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """row, doc_id, n (blocks), name, sha: documents are equal when n and name are."""
    level = named(cut(docs, size), "block").withColumn("left", F.col("n"))
    level = settle(level)
    done = [level.filter("left = 1").drop("pos", "left")]
    while True:
        level = level.filter("left > 1")
        if not level.head(1):
            break
        pairs = level.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n").alias("n"),
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.max(F.ceil(F.col("left") / 2).cast("int")).alias("left"),
        )
        level = settle(named(pairs.withColumnRenamed("at", "pos"), "a", "b"))
        done.append(level.filter("left = 1").drop("pos", "left"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def groups(docs: DataFrame, size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """deduplicate() with `row`, the number of the input's row."""
    bounded_batches(docs.sparkSession)
    rows = identities(id_and_text(docs, id_col, text_col), size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    alike = rows.groupBy("n", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
    # Written out, so that the join below meets two plain tables and a large group can be split.
    alike = settle(alike.filter("group_size > 1"))
    found = rows.join(alike, ["n", "name"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Texts are equal when they are after each run of white space became one space; NULL counts as empty, and empty texts
    are equal to one another.  Of equal texts the smallest doc_id stays (a NULL one only if there is no other);
    of repeated rows with that id exactly one.  The input must give the same rows in the same order when it is
    read again, as tables do.
    """
    return groups(docs, size, id_col, text_col).drop("row")


def distinct(docs: DataFrame, size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    dropped = settle(groups(docs, size, id_col, text_col).filter("NOT kept").select("row"))
    return matching(numbered(docs), dropped, "row", "left_anti").select("doc.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
