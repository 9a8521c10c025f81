"""What the operators share: reading tables, settling rows, slicing batches, components of a graph."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Arrow batches are bounded by their size too, as texts may be very long.
BATCH_BYTES = 4 * 1024 * 1024
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a NULL text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='reviewlake-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame, *sort: str, codec: str = "snappy") -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Drop the shuffle files of finished steps: Spark deletes them once the driver's JVM has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote and no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc: the number of each row as every scan of the table counts it, and all its columns, whatever their names."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))


# Keys up to this number are sent to every executor (16 MB); more are met by a shuffled join.
FEW_KEYS = 2_000_000


def matching(rows: DataFrame, keys: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """A left semi or left anti join; the keys are counted first and only broadcast if they are few."""
    few = keys.count() <= FEW_KEYS
    return rows.join(F.broadcast(keys) if few else keys, key, how)


def freeing(run: Callable) -> Callable:
    """A map over Arrow batches that gives its memory back when a task ends; workers are used again and stay."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.unfreeze()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def slices(texts: pa.Array, most: int = 1024 * 1024) -> Iterator[tuple[int, list]]:
    """(first row, rows) in runs of about `most` bytes; one long text makes a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pa.compute.binary_length(texts).to_pylist()
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + (n or 0) > most:
            yield first, texts.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n or 0
    if first < len(sizes):
        yield first, texts.slice(first).to_pylist()


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Is the remainder of crc32 of the id as text this fold?  A NULL id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def in_company(buckets: DataFrame) -> DataFrame:
    """The rows (band, ...) of buckets that hold more than one, counted in the one shuffle that brings a bucket together."""
    ordered = Window.partitionBy("band").orderBy("band")
    rows = buckets.withColumns({"at": F.row_number().over(ordered), "next": F.lead("band").over(ordered)})
    return rows.filter("at > 1 OR next IS NOT NULL").drop("at", "next")


def bucket_links(
    buckets: DataFrame, verified: Callable[[DataFrame], DataFrame], marks: DataFrame | None = None, likely: Callable[[str, str], Column] | None = None
) -> DataFrame:
    """x, y: verified pairs that connect what all pairs of rows (id) in common buckets (band) would connect.

    All rows of a bucket meet the first by its mark, then its id.  Then rows of one bucket that are in different components
    meet, those beside its largest one with all others.  Pairs whose marks are not likely() to be of similar rows are left
    out.  Marks come by id (marks: id, mark) or by bucket and id, as a column of buckets.
    """
    if marks is not None:
        buckets = buckets.join(marks, "id")
    if "mark" not in buckets.columns:
        buckets = buckets.withColumn("mark", F.lit(0))
    fits = F.lit(True) if likely is None else likely("mark", "of_mark")
    order = lambda x, y: (F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    first = buckets.groupBy("band").agg(F.min(F.struct("mark", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("band", F.col("first.id").alias("of"), F.col("first.mark").alias("of_mark"))
    met = buckets.join(first, "band").filter((F.col("id") != F.col("of")) & fits)
    met = settle(met.select(*order("id", "of")).distinct())
    found = settle(verified(met))
    last = settle(_apart(buckets, found, fits).select(*order("id", "of")).distinct().join(met, ["x", "y"], "left_anti"))
    links = settle(found.union(verified(last)))
    forget(met, found, last)
    return links


def _apart(buckets: DataFrame, links: DataFrame, fits: Column) -> DataFrame:
    """id, of: pairs that fit of one bucket in different components; the rows beside a bucket's largest one meet all others."""
    of = components(links, "x", "y").withColumnRenamed("node", "id")
    placed = settle(buckets.join(of, "id", "left").select("band", "id", "mark", F.coalesce("root", "id").alias("root")))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    mixed = settle(placed.join(most, "band").select("band", "id", "mark", "root", (F.col("root") != F.col("most.root")).alias("beside")))
    forget(placed)
    others = mixed.filter("beside").select(F.col("band").alias("of_band"), F.col("id").alias("of"), F.col("root").alias("of_root"), F.col("mark").alias("of_mark"))
    # The condition is part of the join, so that unlike pairs are compared there and never made.
    apart = (F.col("root") != F.col("of_root")) & (~F.col("beside") | (F.col("id") < F.col("of")))
    return mixed.join(others, (F.col("band") == F.col("of_band")) & apart & fits)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge: the smallest node it is connected with.

    Rounds of large stars and small stars: every node points its larger neighbours, then its smaller ones,
    to the smallest node it sees.  Minima are aggregated before the shuffle and met by joins on the node, which
    adaptive execution splits where a node has very many edges.  Each round's edges are written out, so a
    lost executor costs one round at most.  It ends when a round changes nothing.
    """
    now = settle(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    )

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = sign(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("hi", "lo", "m")
        pairs = F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        after = small.select(F.inline(pairs))
        after = settle(after.filter("hi <> lo").distinct())
        forget(now)
        now, was, seen = after, seen, sign(after)
        if seen == was:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
