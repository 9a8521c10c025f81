"""Publish reports, the index and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from reviewlake.operators.assembly import report_json
from reviewlake.sources import commits, index_store
from reviewlake.sources.commits import names_in, place_of, put_if_absent
from reviewlake.sources.index_store import replace_index
from reviewlake.sources.readers import EVENT_COLUMNS, read_index_or_empty


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per run in a folder ``run=<id>``; only those runs are replaced."""
    (
        reports.select(F.col("id").alias("run"), report_json(0).alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\n")
        .partitionBy("run")
        .text(path)
    )


def delete(spark, path: str) -> None:
    """Remove a folder this library has written."""
    place, files = place_of(spark, path)
    files.delete(place, True)


_BUCKETS = "_buckets-"


def publish_reports(reports: DataFrame, path: str, buckets: int = 256, spread: int = 8) -> None:
    """Report documents as rows in a fixed number of buckets, for very many runs.

    Only the buckets of the given runs are read and rewritten; within them a
    document with the same id is replaced.  The old files stay in place until
    the new ones are complete.  The number of buckets belongs to the folder; another
    one is refused.  Up to ``spread`` tasks write one bucket.
    """
    spark = reports.sparkSession
    marked = [int(n.removeprefix(_BUCKETS)) for n in names_in(spark, path) if n.startswith(_BUCKETS)]
    if marked and marked[0] != buckets:
        raise ValueError(f"{path} has {marked[0]} buckets")
    new = reports.select(F.col("id").alias("run"), report_json().alias("report"))
    merged = new = new.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int"))
    if marked:
        old = spark.read.schema("run string, report string, bucket int").parquet(path)
        touched = new.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(new.select("run"), "run", "left_anti")
        merged = new.unionByName(kept)
    else:
        put_if_absent(spark, f"{path}/{_BUCKETS}{buckets}", "")
    (
        merged.repartition(F.col("bucket"), F.pmod(F.xxhash64("run", F.lit(spread)), F.lit(spread)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def write_index(index: DataFrame, path: str) -> int:
    """The whole index, sorted, as a new version; ``publish_index`` changes parts of one.

    What is being read is never overwritten, so the new index may be derived from the current one.
    Of two publishers at once the second finds its version taken and fails.
    The version before stays for those still reading it; older ones are removed.
    """
    return replace_index(index, path)


def publish_index(
    entries: DataFrame, path: str, *order: str, per_range: int = index_store.PER_RANGE, writer: str | None = None, batch: int | None = None
) -> int:
    """Add or replace entries of the index in ``path``, see ``index_store.publish_index``; an index of an older form is kept."""
    spark = entries.sparkSession
    if not commits.latest(spark, path).version:
        old = read_index_or_empty(spark, path)
        if commits.names_in(spark, path):
            try:
                replace_index(old, path, per_range)
            except index_store.Taken:  # another publisher has just done it
                pass
    return index_store.publish_index(entries, path, *order, per_range=per_range, writer=writer, batch=batch)


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines; absent fields are left out, the report is put in as it is."""
    plain = [c for c in events.columns if c != "report"]
    head = F.to_json(F.struct(*plain))
    if "report" not in events.columns:
        return events.select(head.alias("value"))
    with_report = F.concat(
        F.left(head, F.length(head) - 1), F.lit(',"report":'), F.col("report"), F.lit("}")
    )
    return events.select(F.coalesce(with_report, head).alias("value"))


def _known(events: DataFrame) -> DataFrame:
    return events.select(*[c for c in events.columns if c in {*EVENT_COLUMNS, "ts", "started_at"}])


def write_events(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Append events as lines.  A numbered batch has a folder of its own, so writing it again replaces it."""
    lines = event_lines(_known(events)).write
    if batch is None:
        lines.mode("append").text(path)
    else:
        lines.mode("overwrite").text(f"{path}/batch={batch}")


def stream_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same for a stream of events; start the writer with the trigger of choice."""
    lines = event_lines(_known(events)).writeStream.format("text").outputMode("append")
    return lines.option("checkpointLocation", checkpoint).option("path", path)
