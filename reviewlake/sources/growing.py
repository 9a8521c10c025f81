"""Follow files that grow: a streaming source of text lines with a byte offset per file in its checkpoint.

A line belongs to the micro-batch, and to the task, in which its newline lies.  A task that begins inside a line looks
back for where that line began, so a line cut by the end of a batch or of a part comes whole, and once.  A last line without
its newline waits until it has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from reviewlake.sources.readers import parse_events

FORMAT = "growing_lines"
BLOCK = 1 << 20
# Bytes that one task reads.
PER_TASK = 32 << 20
ROWS = 10_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A path as Hadoop or a shell spells it, as a file system and a path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Span(InputPartition):
    """Bytes of files: (path, start, end) each."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


def dealt(grown: list[tuple[str, int, int]], most: int) -> list[Span]:
    """Spans in tasks of about so many bytes; a large one is divided anywhere, small ones share a task."""
    out: list[list] = []
    room = 0
    for path, start, end in grown:
        while start < end:
            if room <= 0:
                out.append([])
                room = most
            take = min(room, end - start)
            out[-1].append((path, start, start + take))
            start, room = start + take, room - take
    return [Span(spans) for spans in out]


def lines_ending_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its newline) of the lines whose newline is at one of the bytes start to end."""
    rest = b""
    begin = start
    while begin > 0:
        # Back to the end of the line before, block by block.
        low = max(0, begin - BLOCK)
        file.seek(low)
        block = file.read(begin - low)
        cut = block.rfind(b"\n")
        rest = block[cut + 1 :] + rest
        begin = low + cut + 1
        if cut >= 0:
            break
    file.seek(start)
    at = start
    pieces = [rest]
    while at < end:
        block = file.read(min(BLOCK, end - at))
        if not block:
            break
        at += len(block)
        first, *others = block.split(b"\n")
        pieces.append(first)
        for line in others:
            whole = b"".join(pieces)
            yield begin, whole
            begin += len(whole) + 1
            pieces = [line]


class _Lines:
    """What batch and stream share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.suffix = options.get("suffix", ".ndjson")
        self.per_task = int(options.get("bytesPerTask", PER_TASK))

    def sizes(self) -> dict[str, int]:
        files, root = file_system(self.root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        root = root.rstrip("/") + "/"
        return {f.path.removeprefix(root): f.size for f in found if f.is_file and f.path.endswith(self.suffix)}

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files, root = file_system(self.root)
        columns: list[list] = [[], [], []]
        for path, start, end in partition.spans:
            with files.open_input_file(f"{root.rstrip('/')}/{path}") as file:
                for at, line in lines_ending_in(file, start, end):
                    for column, value in zip(columns, (path, at, line.decode("utf-8", "replace"))):
                        column.append(value)
                    if len(columns[0]) >= ROWS:
                        yield self.batch(columns)
                        columns = [[], [], []]
        if columns[0]:
            yield self.batch(columns)

    @staticmethod
    def batch(columns: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "at", "value"])


class _Whole(_Lines, DataSourceReader):
    def partitions(self) -> Sequence[Span]:
        return dealt([(path, 0, size) for path, size in sorted(self.sizes().items())], self.per_task) or [Span([])]


class _Growing(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> Sequence[Span]:
        return dealt([(p, start.get(p, 0), size) for p, size in sorted(end.items()) if size > start.get(p, 0)], self.per_task)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Lines of all files below ``path`` whose names end in ``suffix``: path (below it), at (the line's first byte), value."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, at bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(self.options)


def read_growing_events(spark: SparkSession, path: str, stream: bool = True, suffix: str = ".ndjson", per_task: int = PER_TASK) -> DataFrame:
    """Events of ``<run>.ndjson`` files that are still written to; ``seq`` is the byte at which the line begins.

    As a stream, each micro-batch has the lines that were completed since the one before, whatever piece of them was there
    already; the checkpoint holds how far each file has been read.  All batches together are the rows of one whole read
    (``stream=False``).  Empty lines are skipped.  Files only grow: what is written over, or cut off and written anew below
    the size already read, is not read again.  A run is named by its file's path below ``path``; files can be in any store
    that pyarrow opens.  The offset has an entry per file below ``path``, so let that be a day's folder where runs are many.
    """
    spark.dataSource.register(GrowingLines)
    source = (spark.readStream if stream else spark.read).format(FORMAT)
    lines = source.option("path", path).option("suffix", suffix).option("bytesPerTask", str(per_task)).load()
    run = F.left("path", F.length("path") - len(suffix))
    rows = lines.filter("value <> ''").select(run.alias("run"), F.col("at").alias("seq"), "value")
    return parse_events(rows, "value", "run", "seq")
