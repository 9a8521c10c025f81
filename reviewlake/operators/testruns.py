"""Test results of the original and the fixed version."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.schemas import VERSIONS

_COUNTS = ("passed", "failed", "total")


def all_pass(failed, total) -> Column:
    return (F.col(failed) == 0) & (F.col(total) > 0)


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("run").agg(F.count("*").alias("n_cases"))


def before_after(test_runs: DataFrame) -> DataFrame:
    """test_runs(run, version, passed, failed, total) to one row per run."""
    picked = [
        F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{v}_{c}")
        for v in VERSIONS
        for c in _COUNTS
    ]
    return test_runs.groupBy("run").agg(*picked)


def normalised(passed: Column, failed: Column, total: Column, n_cases: Column) -> dict[str, Column]:
    """Counts of one test run; all NULL where the run has no result.

    A test file that crashes on import reports no tests at all; every case
    then counts as failed.  Other counts stay as reported, skipped tests too.
    """
    crashed = total == 0
    counts = {
        "passed": F.when(crashed, F.lit(0)).otherwise(passed),
        "failed": F.when(crashed, n_cases).otherwise(failed),
        "total": F.when(crashed, n_cases).otherwise(total),
    }
    return {name: count.cast("bigint") for name, count in counts.items()}


def normalise_sides(sides: DataFrame, n_cases: Column, *others: str) -> DataFrame:
    """Rows of ``before_after`` with the counts of both versions normalised, and an all-pass flag each."""
    columns = []
    for v in VERSIONS:
        counts = normalised(*[F.col(f"{v}_{c}") for c in _COUNTS], n_cases)
        columns += [count.alias(f"{v}_{c}") for c, count in counts.items()]
    flags = [all_pass(f"{v}_failed", f"{v}_total").alias(f"{v}_ok") for v in VERSIONS]
    return sides.select("run", *others, *columns).select("*", *flags)


def verification(test_runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Normalised counts of both versions side by side, with an all-pass flag each."""
    sides = before_after(test_runs).join(case_counts(cases), "run", "left")
    return normalise_sides(sides, F.coalesce("n_cases", F.lit(0)))
