"""Publish only what changed, once or continuously.

A manifest beside the reports has the time and size of every file that went into them.  A publish lists the files
in tasks, compares the list with the manifest in one aggregation and opens the files of those runs only that have a new,
changed or missing file.  Reports, rejected runs, index and manifest are written in this order, and each step can be
repeated: a publish that was stopped is done again by the next one.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reviewlake.operators import assembly
from reviewlake.plans.publish import build_reports
from reviewlake.session import configure, settle
from reviewlake.sources import commits, readers, writers
from reviewlake.sources.commits import Commit, Part
from reviewlake.sources.growing import file_system
from reviewlake.sources.listing import list_files, list_folders, read_texts

SEEN = "run string, file string, mtime timestamp, length bigint, publish bigint"
REJECTED = "run string, reason string, detail string"
TRUTH = "*truth*"  # no name of an artifact
_ARTIFACT = r"\.(json|ts|js)\z"
_EXPECTED = r"\A(.*)\.expected\.json\z"


class Changed(NamedTuple):
    runs: int
    version: int  # of the index


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """run, file, mtime, length as they were when the run was published last; a file that was gone then is left out."""
    if not commits.names_in(spark, f"{out}/_seen"):
        return spark.createDataFrame([], SEEN).drop("publish")
    rows = spark.read.schema(SEEN).parquet(f"{out}/_seen")
    last = rows.groupBy("run", "file").agg(F.max_by(F.struct("mtime", "length"), "publish").alias("x"))
    return last.select("run", "file", "x.mtime", "x.length").filter("mtime IS NOT NULL")


def differences(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """run, file, mtime, length of files that are new or changed, and of those that are gone (mtime and length NULL)."""
    columns = ["run", "file", "mtime", "length"]
    both = listed.select(*columns, F.lit(True).alias("here")).unionByName(seen.select(*columns, F.lit(False).alias("here")))
    state = F.struct("mtime", "length")
    sides = both.groupBy("run", "file").agg(
        F.max(F.when(F.col("here"), state)).alias("now"), F.max(F.when(~F.col("here"), state)).alias("was")
    )
    return sides.filter(~F.col("now").eqNullSafe(F.col("was"))).select("run", "file", "now.mtime", "now.length")


def _artifacts(listed: DataFrame) -> DataFrame:
    """Files of run folders as read_runs has them."""
    return listed.filter(F.col("file").rlike(_ARTIFACT)).select(F.col("folder").alias("run"), "file", "path", "mtime", "length")


def _truth_files(listed: DataFrame) -> DataFrame:
    named = listed.filter(F.col("file").rlike(_EXPECTED))
    return named.select(F.regexp_extract("file", _EXPECTED, 1).alias("run"), F.lit(TRUTH).alias("file"), "path", "mtime", "length")


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    parts = commits.latest(spark, f"{out}/rejected").parts
    return spark.read.schema(REJECTED).parquet(f"{out}/rejected/{parts[0].folder}") if parts else spark.createDataFrame([], REJECTED)


def _reject(rejected: DataFrame, changed: DataFrame, out: str) -> None:
    """The rejected rows of the changed runs in place of those they had."""
    spark, path = rejected.sparkSession, f"{out}/rejected"
    while True:
        now = commits.latest(spark, path)
        kept = read_rejected(spark, out).join(changed.select("run").distinct(), "run", "left_anti")
        folder = f"data-{uuid.uuid4().hex}"
        kept.unionByName(rejected.select("run", "reason", "detail")).write.parquet(f"{path}/{folder}")
        if commits.commit(spark, path, Commit(now.version + 1, [Part(folder, 0, None)], {})):
            commits.clean(spark, path)
            return


def _publish(spark: SparkSession, listed: DataFrame, changed: DataFrame, out: str, staging: str, buckets: int, with_truth: bool,
             writer: str | None = None, batch: int | None = None, **options) -> Changed:
    """Reports, rejected runs, index entries and manifest of the changed runs, whose files are all in listed."""
    runs = settle(changed.select("run").distinct(), f"{staging}/runs")
    count = runs.count()
    if not count:
        return Changed(0, commits.latest(spark, f"{out}/index").version)
    texts = settle(read_texts(listed.join(runs, "run", "left_semi")), f"{staging}/texts")
    truth, no_truth = None, None
    if with_truth:
        truth, no_truth = readers.truth_files(texts.filter(F.col("file") == TRUTH).select("run", "text"))
    built = build_reports(texts.filter(F.col("file") != TRUTH), truth, staging=f"{staging}/rows", **options)
    rejected = built.rejected
    if no_truth is not None:
        at = F.concat_ws(".", F.lit("truth"), F.nullif(F.col("bad_path"), F.lit("")))
        rejected = rejected.unionByName(no_truth.select("run", "reason", at.alias("detail")))
    writers.publish_reports(built.reports, f"{out}/reports", buckets)
    _reject(rejected, runs, out)
    version = writers.publish_index(assembly.index_entries(built.reports), f"{out}/index", "recordedAt", writer=writer, batch=batch)
    order = F.lit(version).cast("bigint").alias("publish")
    changed.select("run", "file", "mtime", "length", order).write.mode("append").parquet(f"{out}/_seen")
    return Changed(count, version)


def publish_changed(spark: SparkSession, runs: str, out: str, truth: str | None = None, buckets: int = 256, **options) -> Changed:
    """Publish the runs of which a file, or the ground truth, is new, changed or gone since the last publish.

    Only files of these runs are opened.  A run whose folder is gone keeps its report; one that is no longer complete
    or valid keeps the last one too and is listed as rejected (``read_rejected``).
    """
    configure(spark)
    staging = f"{out}/_staging-{uuid.uuid4().hex}"
    listed = _artifacts(list_files(spark, runs, staging))
    if truth:
        listed = listed.unionByName(_truth_files(list_files(spark, truth, staging)))
    listed = settle(listed, f"{staging}/listed")
    seen = manifest(spark, out)
    if not truth:
        seen = seen.filter(F.col("file") != TRUTH)
    changed = settle(differences(listed, seen), f"{staging}/changed")
    done = _publish(spark, listed, changed, out, staging, buckets, truth is not None, **options)
    writers.delete(spark, staging)
    return done


def publish_batch(arrived: DataFrame, batch: int, runs: str, out: str, writer: str, buckets: int = 256, **options) -> Changed:
    """Publish the runs whose last file (path) arrived; the same batch of the same writer again changes nothing."""
    spark = configure(arrived.sparkSession)
    if commits.latest(spark, f"{out}/index").done.get(writer, -1) >= batch:
        return Changed(0, commits.latest(spark, f"{out}/index").version)
    staging = f"{out}/_staging-{uuid.uuid4().hex}"
    _, root = file_system(readers.qualified(spark, runs))
    folder = F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)
    inside = F.ltrim(F.substring(F.regexp_replace(folder, r"\A[a-z]+:/*", "/"), len(root) + 1, 1 << 30), F.lit("/"))
    folders = settle(arrived.select(folder.alias("path"), inside.alias("folder")).distinct(), f"{staging}/folders")
    listed = settle(_artifacts(list_folders(folders, staging)), f"{staging}/listed")
    # Every listed file goes into the manifest as it is now.
    done = _publish(spark, listed, listed, out, staging, buckets, False, writer, batch, **options)
    writers.delete(spark, staging)
    return done


def publish_stream(spark: SparkSession, runs: str, out: str, checkpoint: str, writer: str, last: str = "report.json", **options) -> DataStreamWriter:
    """Publish runs as they are completed: a run is published when its ``last`` artifact appears.

    Start the returned writer with the trigger of choice.  A batch that was stopped is repeated by the next start and leaves
    what a single run of it leaves; reports and index agree after every batch.  ``writer`` names this stream in the index.
    A file that is replaced later does not come again; ``publish_changed`` finds it.
    """
    arrivals = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", last).load(runs).select("path")
    )
    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda arrived, batch: publish_batch(arrived, batch, runs, out, writer, **options) and None
    )
