"""Stage durations from file times, and the first valid attempt of a stage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The run's own start stamp and the artifacts whose file times end a stage.
STAMPED = ["start", "analysis", "fixed", "fixes", "tests", "report"]
MAX_ATTEMPTS = 2


def _round_ms(micros: Column) -> Column:
    """Whole milliseconds, half up; durations are never negative here."""
    return F.floor((micros + 500) / 1000).cast("bigint")


def gated_spans(start: Column, analyze: Column, fix: Column, test: Column, report: Column) -> dict[str, Column]:
    """The five durations in ms from end times in microseconds.

    All are NULL unless the stages ended in order: the analysis strictly after
    the start, each later stage not before the one ahead of it.
    """
    in_order = (start < analyze) & (analyze <= fix) & (fix <= test) & (test <= report)
    spans = {
        "analyze_ms": analyze - start,
        "fix_ms": fix - analyze,
        "test_ms": test - fix,
        "report_ms": report - test,
        "total_ms": report - start,
    }
    return {name: F.when(in_order, _round_ms(span)) for name, span in spans.items()}


def fix_time(fixed: Column, fixes: Column) -> Column:
    """The fix stage ends with the later of its two files, and needs both."""
    return F.when(fixed.isNotNull() & fixes.isNotNull(), F.greatest(fixed, fixes))


def stage_timings(stamps: DataFrame) -> DataFrame:
    """Per run the five durations, from stamps(run, artifact, ts)."""
    at = F.unix_micros("ts")
    ends = [F.max(F.when(F.col("artifact") == name, at)).alias(name) for name in STAMPED]
    wide = stamps.groupBy("run").agg(*ends)
    spans = gated_spans(
        F.col("start"), F.col("analysis"), fix_time(F.col("fixed"), F.col("fixes")), F.col("tests"), F.col("report")
    )
    return wide.select("run", *[span.alias(name) for name, span in spans.items()])


def live_total(*stage_ms: str) -> Column:
    """Total of a live run: the sum of its separately measured stages."""
    total = F.lit(0).cast("bigint")
    for c in stage_ms:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def first_valid_attempt(attempts: DataFrame) -> DataFrame:
    """Outcome per (run, stage) from attempts(run, stage, attempt, result, error, started, ended).

    ``error`` is NULL for a valid attempt.  The first valid one of at most two
    wins; if none is valid the last error stands.  ``elapsed_ms`` runs from the
    first attempt to the end of the deciding one (times in microseconds).
    """
    outcome = attempts.groupBy("run", "stage").agg(*attempt_aggregates(F.col("attempt") <= MAX_ATTEMPTS, "result", "error"))
    return outcome.filter("_started IS NOT NULL").select("run", "stage", *attempt_outcome("result", "error"))


def attempt_aggregates(counts: Column, result: str, error: str, prefix: str = "") -> list[Column]:
    """The aggregates over the attempts that count, of which ``attempt_outcome`` makes the outcome."""
    valid = counts & F.col(error).isNull()
    return [
        F.min(F.when(valid, F.col("attempt"))).alias(f"{prefix}attempt"),
        F.min_by(result, F.when(valid, F.col("attempt"))).alias(f"{prefix}_result"),
        F.max_by(error, F.when(counts & F.col(error).isNotNull(), F.col("attempt"))).alias(f"{prefix}_error"),
        F.min_by("ended", F.when(valid, F.col("attempt"))).alias(f"{prefix}_won"),
        F.max(F.when(counts, F.col("ended"))).alias(f"{prefix}_ended"),
        F.min(F.when(counts, F.col("started"))).alias(f"{prefix}_started"),
    ]


def attempt_outcome(result: str, error: str, prefix: str = "", elapsed: str = "elapsed_ms") -> list[Column]:
    """attempt, result, error and elapsed time in ms, from ``attempt_aggregates``."""
    failed = F.col(f"{prefix}attempt").isNull()
    return [
        F.col(f"{prefix}attempt"),
        F.when(~failed, F.col(f"{prefix}_result")).alias(result),
        F.when(failed, F.col(f"{prefix}_error")).alias(error),
        _round_ms(F.coalesce(f"{prefix}_won", f"{prefix}_ended") - F.col(f"{prefix}_started")).alias(elapsed),
    ]
