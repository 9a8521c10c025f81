"""Score found issues against seeded bugs with a line tolerance.

A bug is caught when an issue of the same run lies within ``tol`` lines of it.
Both forms below work on (run, line neighbourhood) keys instead of on the run,
so one run holding a large share of all rows still spreads over the cluster and
no pair of bug and issue is ever formed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.nesting import ordered_list

TOLERANCE = 2


def mark_caught(truth: DataFrame, issues: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """Every bug of ``truth(run, line, ...)`` with a ``caught`` flag.

    Lines fall into bins of ``tol + 1``, so two lines of one bin are always in
    reach and only the neighbouring bins need comparing.  The issues around a
    bin shrink to one row; each bug then looks up that row.
    """
    width = tol + 1
    home = F.floor(F.col("line") / width)
    spread = (
        issues.filter(F.col("line").isNotNull())
        .select("run", "line", home.alias("_home"))
        .select("run", "line", "_home", F.explode(F.array(*[F.col("_home") + d for d in (-1, 0, 1)])).alias("_bin"))
    )
    reach = spread.groupBy("run", "_bin").agg(
        F.max(F.when(F.col("_home") < F.col("_bin"), F.col("line"))).alias("_below"),
        F.min(F.when(F.col("_home") > F.col("_bin"), F.col("line"))).alias("_above"),
        F.max(F.col("_home") == F.col("_bin")).alias("_same"),
    )
    near = (
        F.coalesce("_same", F.lit(False))
        | F.coalesce(F.col("_below") >= F.col("line") - tol, F.lit(False))
        | F.coalesce(F.col("_above") <= F.col("line") + tol, F.lit(False))
    )
    return (
        truth.withColumn("_bin", home)
        .join(reach, ["run", "_bin"], "left")
        .withColumn("caught", near)
        .select(*truth.columns, "caught")
    )


def missed_bugs(truth: DataFrame, issues: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """The bugs no issue came near; the exact row form of ``missed``."""
    return mark_caught(truth, issues, tol).filter(~F.col("caught")).drop("caught")


def detection_counts(truth: DataFrame, issues: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """Per run: bugs ``expected`` and ``caught``.

    Two map-side combined aggregations, without a join: issues mark the lines in
    reach, bugs are counted per line.  An issue makes ``2 * tol + 1`` rows.
    """
    reached = F.explode(F.sequence(F.col("line") - tol, F.col("line") + tol))
    marks = issues.filter(F.col("line").isNotNull()).select(
        "run", reached.alias("line"), F.lit(0).alias("bugs"), F.lit(1).alias("hit")
    )
    bugs = truth.select("run", F.col("line"), F.lit(1).alias("bugs"), F.lit(0).alias("hit"))
    per_line = (
        bugs.unionByName(marks)
        .groupBy("run", "line")
        .agg(F.sum("bugs").alias("bugs"), F.max("hit").alias("hit"))
        .filter(F.col("bugs") > 0)
    )
    return per_line.groupBy("run").agg(
        F.sum("bugs").alias("expected"), F.sum(F.col("bugs") * F.col("hit")).alias("caught")
    )


def detection(truth: DataFrame, issues: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """Per run: ``expected``, ``caught`` and the ids ``missed`` in truth order.

    ``truth`` has (run, pos, bug_id, line).  ``missed_bugs`` has the missed ones as rows.
    """
    return (
        mark_caught(truth, issues, tol)
        .groupBy("run")
        .agg(
            F.count("*").alias("expected"),
            F.count_if("caught").alias("caught"),
            ordered_list(F.col("bug_id"), "pos", ~F.col("caught")).alias("missed"),
        )
    )


def with_optional(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores beside every run; a run without ground truth keeps NULL, not 0/0."""
    return runs.join(scored, "run", "left")


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per run by severity, zero counts kept."""
    return issues.groupBy("run").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("High", "Medium", "Low")]
    )
