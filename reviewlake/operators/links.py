"""Links between artifacts, issues, fixes and test cases."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.labels import guard_label
_SPREAD = 64


TESTS_FILE = "*.test.ts"


def is_tests_file(name: Column, tests_file: str = TESTS_FILE) -> Column:
    """The generated tests: one exact name, or ``*`` and an ending."""
    if tests_file.startswith("*"):
        return name.endswith(tests_file[1:])
    return name == tests_file


def lacking_files(
    ext: Column, analysis: Column, fixed: Column, fixes: Column, tests: Column, report: Column,
    tests_file: str = TESTS_FILE,
) -> Column:
    """Names of the required files a run lacks, from a flag per file that is there."""
    names = [
        F.when(~analysis, "analysis.json"),
        F.when(~fixed, F.concat(F.lit("fixed"), ext)),
        F.when(~fixes, "fixes.json"),
        F.when(~tests, tests_file),
        F.when(~report, "report.json"),
    ]
    return F.array_compact(F.array(*names))


def missing_artifacts(runs: DataFrame, files: DataFrame, tests_file: str = TESTS_FILE) -> DataFrame:
    """One row per required file a run lacks, from runs(run, ext) and files(run, file).

    Runs and files go through one aggregation that keeps a flag per required
    name, however many files a run folder holds.
    """
    file = F.col("file")
    seen = {
        "analysis": file == "analysis.json",
        "fixed_ts": file == "fixed.ts",
        "fixed_js": file == "fixed.js",
        "fixes": file == "fixes.json",
        "tests": is_tests_file(file, tests_file),
        "report": file == "report.json",
    }
    none = F.lit(None)
    tagged = runs.select(
        "run", (F.col("ext") == ".ts").alias("is_ts"), none.cast("string").alias("file")
    ).unionByName(files.select("run", none.cast("boolean").alias("is_ts"), "file"))
    flags = (
        tagged.groupBy("run")
        .agg(
            F.max("is_ts").alias("is_ts"),
            *[F.coalesce(F.max(there), F.lit(False)).alias(kind) for kind, there in seen.items()],
        )
        .filter(F.col("is_ts").isNotNull())
    )
    ext = F.when(F.col("is_ts"), ".ts").otherwise(".js")
    fixed = F.when(F.col("is_ts"), F.col("fixed_ts")).otherwise(F.col("fixed_js"))
    lacking = lacking_files(
        ext, F.col("analysis"), fixed, F.col("fixes"), F.col("tests"), F.col("report"), tests_file
    )
    return flags.select("run", F.explode(lacking).alias("missing"))


def fixed_ids(fixes: DataFrame) -> DataFrame:
    return fixes.select("run", "issue_id").distinct()


def issues_with_fix(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """Issues (run, issue_id, ...) with a ``fixed`` flag."""
    done = fixed_ids(fixes).withColumn("_done", F.lit(True))
    return (
        issues.join(done, ["run", "issue_id"], "left")
        .withColumn("fixed", F.coalesce("_done", F.lit(False)))
        .drop("_done")
    )


def cases_with_issue(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """Test cases (run, pos, name, issue_id) beside the issue each one guards.

    Untagged cases have no key to look up; they get a random-looking second
    key so that they do not all land in one partition.
    """
    first = (
        issues.groupBy("run", "issue_id")
        .agg(F.min_by(F.struct("pos", "severity"), F.col("pos")).alias("_issue"))
        .withColumn("_salt", F.lit(0))
    )
    salt = F.when(F.col("issue_id").isNull(), F.pmod(F.xxhash64("name", "pos"), F.lit(_SPREAD)).cast("int") + 1)
    return (
        cases.withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .join(first, ["run", "issue_id", "_salt"], "left")
        .select(
            *cases.columns,
            guard_label("issue_id").alias("guards"),
            F.col("_issue.severity").alias("severity"),
            F.col("_issue").isNotNull().alias("known"),
        )
    )
