"""List and read files in tasks: the driver sees neither names nor contents.

Folders are listed level by level, each level's folders dealt out over tasks.  Texts are opened where they are processed, and
only those asked for.  Paths are in any store that pyarrow opens; ``readers.read_files`` reads the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import settle
from reviewlake.sources.growing import file_system

LISTED = "folder string, file string, path string, mtime timestamp, length bigint"
# Text that is handed on at once.
BATCH_BYTES = 16 << 20
FOLDERS_PER_TASK = 200


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, folder) to what lies directly in them; a folder's row has no file."""
    for batch in batches:
        rows: list[tuple] = []
        for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
            files, place = file_system(path)
            for f in files.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                inside = f"{folder}/{f.base_name}".lstrip("/")
                here = f"{path}/{f.base_name}"
                if f.type == fs.FileType.Directory:
                    rows.append((inside, None, here, None, None))
                elif f.is_file:
                    # Whole milliseconds, as Spark's own listing has them.
                    rows.append((folder, f.base_name, here, f.mtime_ns // 1_000_000 * 1000, f.size))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.record_batch(columns, names=["folder", "file", "path", "mtime", "length"])


def list_folders(folders: DataFrame, staging: str) -> DataFrame:
    """folder, file, path, mtime, length of all files in and below folders (path, folder); each level is written to staging."""
    spark = folders.sparkSession
    out = spark.createDataFrame([], LISTED)
    level = folders.select(F.rtrim("path", F.lit("/")).alias("path"), "folder")
    while True:
        # A few folders a task, so that one large level is listed by many.
        tasks = max(1, -(-level.count() // FOLDERS_PER_TASK))
        found = level.repartition(tasks).mapInArrow(_listed, "folder string, file string, path string, mtime bigint, length bigint")
        found = settle(found, f"{staging}/level-{uuid.uuid4().hex}")
        here = found.filter("file IS NOT NULL")
        out = out.unionByName(here.withColumn("mtime", F.timestamp_micros("mtime")))
        level = found.filter("file IS NULL").select("path", "folder")
        if not level.head(1):
            return out


def list_files(spark: SparkSession, root: str, staging: str) -> DataFrame:
    return list_folders(spark.createDataFrame([(root, "")], "path string, folder string"), staging)


def read_texts(files: DataFrame) -> DataFrame:
    """Add ``text`` to rows with a path; bytes that are not UTF-8 become U+FFFD.  A file that is gone has no row."""
    columns = files.columns
    place = columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            kept: list[int] = []
            size = 0
            for i, path in enumerate(batch.column(place).to_pylist()):
                store, inside = file_system(path)
                try:
                    with store.open_input_file(inside) as file:
                        text = file.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                texts.append(text)
                kept.append(i)
                size += len(text)
                if size > BATCH_BYTES:
                    yield pa.record_batch([*batch.take(pa.array(kept)).columns, pa.array(texts, pa.string())], names=[*columns, "text"])
                    texts, kept, size = [], [], 0
            if kept:
                yield pa.record_batch([*batch.take(pa.array(kept)).columns, pa.array(texts, pa.string())], names=[*columns, "text"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{ddl}, text string")
