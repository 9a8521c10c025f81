"""Run folders to published reports, in one job.

All files of a run come together in one shuffle; everything but the scoring
against ground truth is then computed within the run's row.
"""

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions import strict_json as J
from reviewlake.functions import text as T
from reviewlake.operators import assembly, links, scoring, testruns, timing
from reviewlake.operators import validation as V
from reviewlake.session import configure, settle
from reviewlake.sources import readers, writers

META = J.fields(
    name=J.text(),
    fileName=J.text(),
    language=J.one_of(S.LANGUAGES),
    ext=J.one_of(S.SUPPORTED_EXTENSIONS),
    startedAt=J.text(),
)
# Artifact, its check, and its type.  Checked in this order.
_DOCUMENTS = {
    "meta": (META, S.META),
    "analysis": (V.ANALYSIS, S.ANALYSIS),
    "fixes": (V.FIX_LIST, f"array<{S.FIX_ITEM}>"),
    "report": (V.SUMMARY, S.SUMMARY),
    "vitest_original": (readers.TEST_RESULT, S.TEST_RESULT),
    "vitest_fixed": (readers.TEST_RESULT, S.TEST_RESULT),
}


class Published(NamedTuple):
    reports: DataFrame  # schemas.REPORT columns
    rejected: DataFrame  # run, reason, detail


def run_rows(files: DataFrame, tests_file: str = links.TESTS_FILE) -> DataFrame:
    """files(run, file, mtime, text) to one row per run, a column per artifact.

    Files that are no artifacts are dropped before the shuffle.
    """
    file = F.col("file")
    names: dict[str, Column] = {
        "meta": file == "meta.json",
        "analysis": file == "analysis.json",
        "fixes": file == "fixes.json",
        "report": file == "report.json",
        "tests": links.is_tests_file(file, tests_file),
        **{f"{v}_{e[1:]}": file == f"{v}{e}" for v in S.VERSIONS for e in S.SUPPORTED_EXTENSIONS},
        **{f"vitest_{v}": file == f"vitest-{v}.json" for v in S.VERSIONS},
    }
    picked = [
        # Where a pattern fits several files the last name counts; texts are not compared.
        F.max_by(F.when(is_it, F.struct("text", "mtime", "file")), F.when(is_it, file)).alias(name)
        for name, is_it in names.items()
    ]
    artifacts = files.filter(reduce(Column.__or__, names.values()))
    return artifacts.groupBy("run").agg(*picked)


def _by_ext(version: str) -> Column:
    return F.when(F.col("meta_doc.ext") == ".ts", F.col(f"{version}_ts")).otherwise(F.col(f"{version}_js"))


def _checked_rows(rows: DataFrame, tests_file: str) -> DataFrame:
    """Add ``<name>_doc`` per JSON artifact, and the first ``reason`` and ``detail``."""
    reasons = []
    for name, (check, ddl) in _DOCUMENTS.items():
        rows = rows.withColumn("_text", F.col(f"{name}.text"))
        rows = V.check_json(rows, "_text", check, ddl, f"{name}_doc").drop("_text")
        rows = rows.withColumnsRenamed({"reason": f"{name}_reason", "bad_path": f"{name}_path"})
        at = F.concat_ws(".", F.lit(name), F.nullif(F.col(f"{name}_path"), F.lit("")))
        problem = F.struct(F.col(f"{name}_reason").alias("reason"), at.alias("detail"))
        reasons.append(F.when(F.col(f"{name}_reason").isNotNull(), problem))
    lacking = links.lacking_files(
        F.col("meta_doc.ext"),
        F.col("analysis").isNotNull(),
        _by_ext("fixed").isNotNull(),
        F.col("fixes").isNotNull(),
        F.col("tests").isNotNull(),
        F.col("report").isNotNull(),
        tests_file,
    )
    no_meta = F.when(F.col("meta").isNull(), F.struct(F.lit("no_run").alias("reason"), F.lit("meta.json").alias("detail")))
    missing = F.when(
        F.size(lacking) > 0,
        F.struct(F.lit("missing").alias("reason"), F.array_join(lacking, ", ").alias("detail")),
    )
    no_result = [
        F.when(F.col(f"vitest_{v}").isNull(), F.struct(F.lit("no_test_result").alias("reason"), F.lit(v).alias("detail")))
        for v in S.VERSIONS
    ]
    no_original = F.when(
        _by_ext("original").isNull(), F.struct(F.lit("missing").alias("reason"), F.lit("original").alias("detail"))
    )
    first = F.coalesce(no_meta, reasons[0], missing, *no_result, no_original, *reasons[1:])
    return rows.withColumn("problem", first)


def _scores(good: DataFrame, truth: DataFrame) -> DataFrame:
    """Detection per run with ground truth, 0 of 0 where that holds no bugs."""
    issues = good.select("run", F.explode("analysis_doc.errors").alias("e")).select("run", F.col("e.line").alias("line"))
    scored = scoring.detection(readers.truth_bugs(truth), issues)
    none = F.col("expected").isNull()
    return truth.select("run").join(scored, "run", "left").select(
        "run",
        F.coalesce("expected", F.lit(0).cast("bigint")).alias("expected"),
        F.coalesce("caught", F.lit(0).cast("bigint")).alias("caught"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("missed")).alias("missed"),
    )


def build_reports(
    files: DataFrame,
    truth: DataFrame | None = None,
    *,
    kind: str = S.RECORDED,
    model: str | None = None,
    author: str | None = None,
    with_timings: bool = True,
    method: str = assembly.TIMING_METHOD,
    tests_file: str = links.TESTS_FILE,
    staging: str | None = None,
) -> Published:
    """Reports of all complete, valid runs; the others with the first thing wrong.

    ``staging`` names a new folder to write the checked runs to once, for use by several outputs.
    """
    rows = _checked_rows(run_rows(files, tests_file), tests_file)
    if staging:
        rows = settle(rows, staging)
    good = rows.filter(F.col("problem").isNull())
    cases = F.transform(
        T.case_titles("tests.text"),
        lambda title: F.struct(title.alias("name"), T.issue_tag(title).alias("issueId")),
    )
    good = good.withColumns({"_cases": cases, "_fixed": _by_ext("fixed"), "_original": _by_ext("original")})

    def side(version):
        result = F.col(f"vitest_{version}_doc")
        counts = testruns.normalised(
            result["numPassedTests"], result["numFailedTests"], result["numTotalTests"], F.size("_cases")
        )
        return F.struct(*[c.alias(n) for n, c in counts.items()]).alias(version)

    at = {n: F.unix_micros(F.col(f"{n}.mtime")) for n in ("analysis", "_fixed", "fixes", "tests", "report")}
    spans = timing.gated_spans(
        F.unix_micros(T.parse_iso("meta_doc.startedAt")),
        at["analysis"],
        timing.fix_time(at["_fixed"], at["fixes"]),
        at["tests"],
        at["report"],
    )
    good = good.withColumns(spans if with_timings else {n: F.lit(None).cast("bigint") for n in spans})
    detection = F.lit(None)
    if truth is not None:
        good = good.join(_scores(good, truth), "run", "left")
        detection = assembly.detection_struct()
    command = F.concat(F.lit("npx vitest run runs/"), "run", F.lit("/"), "tests.file")
    reports = good.select(
        F.lit(1).alias("schemaVersion"),
        F.col("run").alias("id"),
        F.col("run").alias("title"),
        F.col("meta_doc.fileName").alias("fileName"),
        F.col("meta_doc.language").alias("language"),
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(model).cast("string").alias("model"),
            T.iso_time("report.mtime").alias("recordedAt"),
            F.lit(author).cast("string").alias("author"),
        ).alias("source"),
        F.col("_original.text").alias("originalCode"),
        F.col("analysis_doc").alias("analysis"),
        F.struct(F.col("_fixed.text").alias("fixedCode"), F.col("fixes_doc").alias("fixes")).alias("fix"),
        F.struct(F.lit("vitest").alias("framework"), F.col("tests.text").alias("code"), F.col("_cases").alias("cases")).alias("tests"),
        F.col("report_doc").alias("report"),
        F.struct(command.alias("command"), *[side(v) for v in S.VERSIONS]).cast(S.VERIFICATION).alias("verification"),
        detection.cast(S.DETECTION).alias("detection"),
        assembly.timings_struct(method).cast(S.TIMINGS).alias("timings"),
    )
    rejected = rows.filter(F.col("problem").isNotNull()).select("run", "problem.*")
    return Published(reports, rejected)


def publish_runs(
    spark: SparkSession,
    runs: str,
    out: str,
    truth: str | None = None,
    buckets: int | None = None,
    **options,
) -> Published:
    """Read run folders, write their reports and update the index.

    ``buckets`` selects the layout for very many runs (see ``sources.writers``).  Runs with a problem
    and ground truth that is none are written to ``rejected`` beside the reports.  What is returned reads the written tables.
    """
    configure(spark)
    staging = f"{out}/_staging-{uuid.uuid4().hex}"
    truth_rows, no_truth = readers.read_truth(spark, truth) if truth else (None, None)
    built = build_reports(readers.read_runs(spark, runs), truth_rows, staging=staging, **options)
    if buckets is None:
        writers.write_reports(built.reports, f"{out}/reports")
    else:
        writers.publish_reports(built.reports, f"{out}/reports", buckets)
    rejected = built.rejected
    if no_truth is not None:
        at = F.concat_ws(".", F.lit("truth"), F.nullif(F.col("bad_path"), F.lit("")))
        rejected = rejected.unionByName(no_truth.select("run", "reason", at.alias("detail")))
    rejected.write.mode("overwrite").parquet(f"{out}/rejected")
    entries = assembly.index_entries(built.reports)
    writers.publish_index(entries, f"{out}/index", "recordedAt")
    writers.delete(spark, staging)
    return Published(readers.read_published(spark, f"{out}/reports").valid, spark.read.parquet(f"{out}/rejected"))
