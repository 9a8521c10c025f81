"""Stored answers of live reviews to reports.

The answers were given outside, at most two per stage; this job picks the first
valid one of each stage and assembles what the four stages agreed on.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.operators import assembly, timing
from reviewlake.operators import validation as V
from reviewlake.plans.publish import Published

def stage_outcomes(responses: DataFrame) -> DataFrame:
    """Per run the answer of each stage, its ``<stage>_error`` and ``<stage>_ms``, and when the last answer ended.

    responses(run, stage, attempt, text, started, ended), times in microseconds.  Every answer is
    checked against its own stage's shape; all stages are then folded in one aggregation.
    """
    rows = responses.select("run", "stage", "attempt", "text", "started", "ended")
    folds = []
    for stage in S.STAGES:
        check, ddl = V.STAGE_SHAPES[stage]
        mine = F.col("stage") == stage
        rows = V.check_response(rows.withColumn("_mine", F.when(mine, F.col("text"))), "_mine", check, ddl, f"{stage}_value")
        rows = rows.withColumnRenamed("reason", f"{stage}_reason").drop("_mine", "bad_path")
        counts = mine & (F.col("attempt") <= timing.MAX_ATTEMPTS)
        folds += timing.attempt_aggregates(counts, f"{stage}_value", f"{stage}_reason", f"{stage}_")
    wide = rows.groupBy("run").agg(*folds, F.max("ended").alias("_ended"))
    picked = [c for s in S.STAGES for c in timing.attempt_outcome(s, f"{s}_error", f"{s}_", f"{s}_ms")[1:]]
    return wide.select("run", *picked, "_ended")


def live_reports(requests: DataFrame, responses: DataFrame, model: str, method: str) -> Published:
    """requests(run, code, language, file_name) with their answers to reports.

    A run whose stage failed or is still missing is rejected with that stage;
    stages follow each other, so the first one counts.  Live reports have no
    test runs and no detection.
    """
    rows = requests.join(stage_outcomes(responses), "run", "left")
    problem = F.coalesce(
        *[
            F.when(
                F.col(stage).isNull(),
                F.struct(
                    F.lit(f"{stage} stage failed").alias("reason"),
                    F.coalesce(f"{stage}_error", F.lit("no answer")).alias("detail"),
                ),
            )
            for stage in S.STAGES
        ]
    )
    rows = rows.withColumn("problem", problem)
    total = timing.live_total(*[f"{stage}_ms" for stage in S.STAGES])
    none = F.lit(None)
    reports = (
        rows.filter(F.col("problem").isNull())
        .withColumn("total_ms", total)
        .select(
            F.lit(1).alias("schemaVersion"),
            F.col("run").alias("id"),
            F.col("file_name").alias("title"),
            F.col("file_name").alias("fileName"),
            "language",
            F.struct(
                F.lit(S.LIVE).alias("kind"),
                F.lit(model).alias("model"),
                F.date_format(F.timestamp_micros("_ended"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("recordedAt"),
                none.cast("string").alias("author"),
            ).alias("source"),
            F.col("code").alias("originalCode"),
            F.col("analyze").alias("analysis"),
            "fix",
            F.col("test").alias("tests"),
            "report",
            none.cast(S.VERIFICATION).alias("verification"),
            none.cast(S.DETECTION).alias("detection"),
            assembly.timings_struct(method).cast(S.TIMINGS).alias("timings"),
        )
    )
    rejected = rows.filter(F.col("problem").isNotNull()).select("run", "problem.*")
    return Published(reports, rejected)
