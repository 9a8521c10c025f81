"""Read run folders, reports, ground truth, templates, test results and events.

Texts are read whole and kept as text until they are validated.  Only listing
touches the driver; contents are read where they are processed, and a query
that needs just names and times never opens the files.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions import strict_json as J
from reviewlake.functions.text import file_meta, file_name_parts
from reviewlake.operators.validation import (
    Checked,
    check_json,
    split_checked,
    supported_files,
    validate_reports,
)
from reviewlake.sources import commits
from reviewlake.sources.commits import names_in
from reviewlake.sources.index_store import read_parts

TEST_RESULT = J.fields(
    numPassedTests=J.integer(), numFailedTests=J.integer(), numTotalTests=J.integer()
)
TRUTH = J.fields(
    bugs=J.list_of(J.fields(id=J.text(), line=J.integer(), description=J.optional(J.text())))
)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark spells it in the paths of its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file below ``path``: folder, file, path, mtime and its text.

    ``folder`` is the path of the file's folder below ``path``, so folders of one
    name in different places stay apart.  Bytes that are not UTF-8 become U+FFFD.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    parts = F.split("path", "/")
    depth = len(qualified(spark, path).split("/"))
    return files.select(
        F.array_join(F.slice(parts, depth + 1, F.size(parts) - depth - 1), "/").alias("folder"),
        F.element_at(parts, -1).alias("file"),
        "path",
        F.col("modificationTime").alias("mtime"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Artifacts of all run folders below ``root``: run, file, mtime, text.

    A run is named by its folder's path below ``root``.
    """
    return read_files(spark, root, "*.{json,ts,js}").select(
        F.col("folder").alias("run"), "file", "mtime", "text"
    )


def read_reports(spark: SparkSession, path: str) -> Checked:
    """Published report documents, validated; the index file is not a report."""
    files = read_files(spark, path, "*.json").filter(F.col("file") != "index.json")
    checked = validate_reports(files.select("path", "text"), "text")
    return Checked(checked.valid.select("report.*"), checked.rejected)


def read_published(spark: SparkSession, path: str) -> Checked:
    """Reports as ``write_reports`` or ``publish_reports`` have left them, validated again."""
    if any(name.startswith("bucket=") for name in names_in(spark, path)):
        rows = spark.read.schema("run string, report string, bucket int").parquet(path)
        texts = rows.select("run", F.col("report").alias("text"))
    else:
        whole = spark.read.format("text").option("wholetext", "true").schema("value string, run string")
        rows = whole.load(path)
        texts = rows.select("run", F.col("value").alias("text"))
    checked = validate_reports(texts, "text")
    return Checked(checked.valid.select("report.*"), checked.rejected)


def read_truth(spark: SparkSession, path: str) -> Checked:
    """Ground truth files ``<run>.expected.json``: run and its list of bugs, maybe empty."""
    files = read_files(spark, path, "*.expected.json")
    run = F.regexp_extract("file", r"\A(.*)\.expected\.json\z", 1)
    return truth_files(files.select(run.alias("run"), "text"))


def truth_files(files: DataFrame) -> Checked:
    """Texts of ground truth files by run."""
    checked = check_json(files.select("run", "text"), "text", TRUTH, S.TRUTH)
    valid, rejected = split_checked(checked)
    return Checked(valid.select("run", "value.bugs"), rejected)


def truth_bugs(truth: DataFrame) -> DataFrame:
    """Ground truth as rows: run, pos, bug_id, line, description."""
    bugs = truth.select("run", F.posexplode("bugs").alias("pos", "bug"))
    return bugs.select(
        "run",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("bug.id").alias("bug_id"),
        F.col("bug.line").alias("line"),
        F.col("bug.description").alias("description"),
    )


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source files that can be reviewed, with name, extension and language."""
    files = read_files(spark, path).select("path", "mtime", "text")
    return supported_files(file_meta(files, "path"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates by name."""
    files = read_files(spark, path, "*.md")
    return files.select(file_name_parts("file")[0].alias("name"), F.col("text").alias("template"))


def test_results(files: DataFrame) -> Checked:
    """Result files ``vitest-<version>.json`` of read_runs rows, one per run and version."""
    version = F.regexp_extract("file", r"\Avitest-(.*)\.json\z", 1)
    found = files.select("run", version.alias("version"), "text").filter(
        F.col("version").isin(S.VERSIONS)
    )
    checked = split_checked(
        check_json(found, "text", TEST_RESULT, S.TEST_RESULT)
    )
    counts = checked.valid.select(
        "run",
        "version",
        F.col("value.numPassedTests").alias("passed"),
        F.col("value.numFailedTests").alias("failed"),
        F.col("value.numTotalTests").alias("total"),
    )
    return Checked(counts, checked.rejected)


def read_test_results(spark: SparkSession, root: str) -> Checked:
    return test_results(read_files(spark, root, "vitest-*.json").withColumnRenamed("folder", "run"))


INDEX = J.list_of(
    J.fields(
        id=J.text(), fileName=J.text(), recordedAt=J.text(), author=J.optional(J.nullable(J.text())), issues=J.integer()
    )
)


def _old_version(spark: SparkSession, path: str) -> int:
    """The newest complete `version=<n>` folder, as indexes were written before they had a log; 0 without one."""
    found = [int(n.removeprefix("version=")) for n in names_in(spark, path) if n.startswith("version=")]
    return max([v for v in found if "_SUCCESS" in names_in(spark, f"{path}/version={v}")], default=0)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as the newest commit has it, as older versions of this library wrote it, or as one JSON list.

    The list is a file, or ``index.json`` in the folder; a file that is no such list is an error.
    """
    now = commits.latest(spark, path)
    if now.version:
        return read_parts(spark, path, now.parts)
    version = _old_version(spark, path)
    if version:
        return spark.read.schema(S.INDEX_ENTRY).json(f"{path}/version={version}")
    files = read_files(spark, path, "*.json").filter(F.col("file").isin("index.json", path.rsplit("/", 1)[-1]))
    ddl = f"array<struct<{S.INDEX_ENTRY.replace(' ', ': ')}>>".replace(",: ", ", ")
    checked = check_json(files.select("file", "text"), "text", INDEX, ddl, "entries")
    broken = F.raise_error(F.concat("file", F.lit(" is no index: "), "reason", F.lit(" "), F.coalesce("bad_path", F.lit(""))))
    entries = F.when(F.col("reason").isNull(), F.col("entries")).otherwise(F.when(broken.isNull(), F.col("entries")))
    return checked.select(F.inline(entries))


def read_index_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_index``, but no index yet is an empty one."""
    names = names_in(spark, path)
    if commits.LOG in names or _old_version(spark, path) or "index.json" in names or path.endswith(".json") and names:
        return read_index(spark, path)
    return spark.createDataFrame([], S.INDEX_ENTRY)


# --- events -----------------------------------------------------------------

_EVENT_FIELDS = {
    "type": "string",
    "stage": "string",
    "status": "string",
    "ms": "double",
    "error": "string",
    "message": "string",
}
EVENT_COLUMNS = ["run", "seq", *_EVENT_FIELDS, "report"]


def parse_events(lines: DataFrame, line: str, *keys: str) -> DataFrame:
    """One event per JSON line; a line that is not JSON ends its run as an error event."""
    parsed = lines.withColumn("_v", J.parse_strict(line))
    bad = F.col("_v").isNull()
    fields = {n: F.try_variant_get("_v", f"$.{n}", t) for n, t in _EVENT_FIELDS.items()}
    fields["type"] = F.when(bad, "error").otherwise(fields["type"])
    fields["message"] = F.when(bad, "bad_json").otherwise(fields["message"])
    report = F.to_json(F.try_variant_get("_v", "$.report", "variant"))
    return parsed.select(*keys, *[c.alias(n) for n, c in fields.items()], report.alias("report"))


def _event_reader(spark: SparkSession, stream: bool, per_batch: int | None):
    reader = (spark.readStream if stream else spark.read).format("text").schema("value string")
    return reader.option("maxFilesPerTrigger", per_batch) if stream and per_batch else reader


def read_event_files(
    spark: SparkSession, path: str, stream: bool = False, per_batch: int | None = None
) -> DataFrame:
    """One ``<run>.ndjson`` file per run; ``seq`` is the line number.

    Empty lines are skipped, and so is a last line without its newline.  A
    stream reads each file once, so files must be whole when they appear; a log
    that grows is read as event lines.  ``per_batch`` limits the files of one micro-batch.
    """
    files = (
        _event_reader(spark, stream, per_batch).option("wholetext", "true")
        .option("pathGlobFilter", "*.ndjson").load(path)
        .select(
            F.regexp_extract("_metadata.file_path", r"([^/]*)\.ndjson\z", 1).alias("run"),
            F.slice(F.split("value", "\n", -1), 1, F.size(F.split("value", "\n", -1)) - 1).alias("lines"),
        )
    )
    lines = files.select("run", F.posexplode("lines").alias("seq", "line")).filter("line <> ''")
    return parse_events(
        lines.select("run", F.col("seq").cast("bigint").alias("seq"), "line"), "line", "run", "seq"
    )


def read_event_lines(
    spark: SparkSession, path: str, stream: bool = False, per_batch: int | None = None
) -> DataFrame:
    """Event lines of many runs, as ``write_events`` writes them (run and seq inside)."""
    lines = _event_reader(spark, stream, per_batch).load(path).filter("value <> ''")
    keyed = lines.withColumn("_k", J.parse_strict("value")).select(
        F.try_variant_get("_k", "$.run", "string").alias("run"),
        F.try_variant_get("_k", "$.seq", "bigint").alias("seq"),
        F.try_variant_get("_k", "$.ts", "timestamp").alias("ts"),
        F.try_variant_get("_k", "$.started_at", "timestamp").alias("started_at"),
        "value",
    )
    return parse_events(keyed, "value", "run", "seq", "ts", "started_at")
