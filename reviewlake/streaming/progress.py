"""Fold progress events into stage states and run outcomes.

Events have run, seq (any orderable value), type, stage, status, ms, ts,
message and report.  The first five functions serve batch and streaming alike
where they only aggregate; ``until_first_error`` and ``run_outcome`` are batch,
``follow_runs`` is their streaming counterpart.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewlake.functions.labels import fmt_secs
from reviewlake.schemas import STAGES

PENDING = "pending"


def _stage_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "stage")


def stage_state(events: DataFrame, *extra: str) -> DataFrame:
    """Last status per (run, stage); ``ms`` is the last one any event carried.

    ``extra`` are further grouping columns, such as a watermarked run start.
    """
    return _stage_events(events).groupBy("run", *extra, "stage").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq"))).alias("ms"),
    )


def stage_elapsed(events: DataFrame, *extra: str) -> DataFrame:
    """Milliseconds from the first ``running`` to the last ``done`` of a stage."""
    at = F.unix_micros("ts")
    spans = _stage_events(events).groupBy("run", *extra, "stage").agg(
        F.min(F.when(F.col("status") == "running", at)).alias("_from"),
        F.max(F.when(F.col("status") == "done", at)).alias("_to"),
    )
    elapsed = F.col("_to") - F.col("_from")
    # Only a stage that ran and finished after that has a duration.
    return spans.select(
        "run", *extra, "stage",
        F.when(elapsed >= 0, F.floor((elapsed + 500) / 1000).cast("bigint")).alias("elapsed_ms"),
    )


def stage_progress(events: DataFrame, *extra: str) -> DataFrame:
    """All four stages of every run in fixed order, with state and seconds.

    One aggregation keeps a column per stage; stages not seen are pending.
    """
    picks: list[Column] = []
    for stage in STAGES:
        mine = (F.col("type") == "stage") & (F.col("stage") == stage)
        picks += [
            F.max_by("status", F.when(mine, F.col("seq"))).alias(f"{stage}_status"),
            F.max_by("ms", F.when(mine & F.col("ms").isNotNull(), F.col("seq"))).alias(f"{stage}_ms"),
        ]
    wide = events.groupBy("run", *extra).agg(*picks)
    rows = [
        F.struct(
            F.lit(i).alias("stage_no"),
            F.lit(stage).alias("stage"),
            F.coalesce(f"{stage}_status", F.lit(PENDING)).alias("status"),
            fmt_secs(f"{stage}_ms").alias("seconds"),
        )
        for i, stage in enumerate(STAGES)
    ]
    return wide.select("run", *extra, F.inline(F.array(*rows)))


def first_errors(events: DataFrame) -> DataFrame:
    """Per run the seq and message of its first error event."""
    return (
        events.filter(F.col("type") == "error")
        .groupBy("run")
        .agg(F.min("seq").alias("error_seq"), F.min_by("message", "seq").alias("message"))
    )


def until_first_error(events: DataFrame) -> DataFrame:
    """The events a reader sees: those before the first error event of their run.

    The error side has one row per run, so a run with very many events splits
    freely over tasks.  Feed the result to ``stage_state`` and the others.
    """
    stops = first_errors(events).select("run", "error_seq")
    return (
        events.join(stops, "run", "left")
        .filter(F.col("error_seq").isNull() | (F.col("seq") < F.col("error_seq")))
        .drop("error_seq")
    )


def run_outcome(events: DataFrame) -> DataFrame:
    """Per run: how it ended, the error's message, the last report, events read.

    Reading stops at the first error event; a report that came before it stands.
    """
    stops = first_errors(events).withColumnRenamed("message", "error_message")
    seen = events.join(stops, "run", "left").filter(
        F.col("error_seq").isNull() | (F.col("seq") <= F.col("error_seq"))
    )
    is_result = F.col("type") == "result"
    per_run = seen.groupBy("run").agg(
        F.max("error_message").alias("message"),
        F.max(F.col("type") == "error").alias("_failed"),
        F.max(is_result).alias("_done"),
        F.max_by("report", F.when(is_result, F.col("seq"))).alias("report"),
        F.count("*").alias("events_read"),
    )
    outcome = F.when(F.col("_failed"), "error").when(F.col("_done"), "result").otherwise("open")
    return per_run.select("run", outcome.alias("outcome"), "message", "report", "events_read")


# --- streaming --------------------------------------------------------------


def watch_progress(events: DataFrame, delay: str) -> DataFrame:
    """Streaming ``stage_progress``, to be written in update mode.

    Events of runs that started longer than ``delay`` before the newest one are
    late and not counted; the query's progress reports their number
    (``numRowsDroppedByWatermark``).

    ``started_at`` is the start time every event of a run carries.  As part of
    the grouping key it lets the watermark drop runs that started longer ago
    than ``delay``, which bounds the state.
    """
    return stage_progress(events.withWatermark("started_at", delay), "started_at")


def watch_elapsed(events: DataFrame, delay: str) -> DataFrame:
    """Streaming ``stage_elapsed``; late events as in ``watch_progress``."""
    return stage_elapsed(events.withWatermark("started_at", delay), "started_at")


def prepare_session(spark: SparkSession) -> SparkSession:
    """State settings for ``follow_runs``, read when a query of the session starts.

    Timed state lives in RocksDB; it expires along with new data, so a query
    over what is available now comes to an end.  They hold for every query the
    session starts from then on; ``watch_progress`` and ``watch_elapsed`` give the
    same rows with and without them.  Use a session of its own
    (``spark.newSession()``) to keep others as they are.
    """
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return spark


_OUTCOME = "run string, outcome string, message string, report string, events_read bigint, stages string"
_EVENT = "type string, stage string, status string, ms bigint, report string"


class _RunFold(StatefulProcessor):
    """Fold the events of one run by their seq, in whatever order and pieces they arrive.

    Kept are the events before the first error known so far, by seq, and that error as a tombstone.  An
    earlier error drops the events behind it; events behind the tombstone are not kept at all.
    """

    def __init__(self, quiet_ms: int, tombstone_ms: int):
        self.quiet_ms, self.tombstone_ms = quiet_ms, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "seq bigint", _EVENT, ttlDurationMs=self.quiet_ms)
        self.stop = handle.getValueState("stop", "seq bigint, message string", ttlDurationMs=self.tombstone_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stop = self.stop.get() if self.stop.exists() else None
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            for e in batch.itertuples(index=False):
                if stop is not None and e.seq >= stop[0]:
                    continue
                if e.type == "error":
                    stop = (int(e.seq), e.message)
                    self.stop.update(stop)
                else:
                    ms = None if e.ms is None else int(e.ms)
                    self.events.updateValue((int(e.seq),), (e.type, e.stage, e.status, ms, e.report))
        kept = []
        for seq, event in list(self.events.iterator()):
            if stop is not None and seq[0] > stop[0]:
                self.events.removeKey(seq)
            else:
                kept.append((seq[0], *event))
        kept.sort(key=lambda e: e[0])
        results = [e for e in kept if e[1] == "result"]
        states = []
        for stage in STAGES:
            mine = [e for e in kept if e[1] == "stage" and e[2] == stage]
            spans = [e[4] for e in mine if e[4] is not None]
            states.append(f"{mine[-1][3] if mine else PENDING}:{spans[-1] if spans else ''}")
        outcome = "error" if stop is not None else "result" if results else "open"
        yield pd.DataFrame(
            {
                "run": [key[0]],
                "outcome": [outcome],
                "message": [None if stop is None else stop[1]],
                "report": [results[-1][5] if results else None],
                "events_read": [len(kept) + (stop is not None)],
                "stages": [",".join(states)],
            }
        )

    def close(self) -> None:
        pass


def follow_runs(events: DataFrame, quiet_ms: int, tombstone_ms: int) -> DataFrame:
    """Streaming run outcomes, one updated row per run and micro-batch; ``stages`` has ``status:ms`` of each.

    Rows equal ``run_outcome`` over the events so far, however they are cut into files, micro-batches and
    Arrow batches; a seq that comes twice counts once.  The state of a run is its events before the
    first error.  The caller names its bounds: events are forgotten ``quiet_ms`` after they came, the
    tombstone of a stopped run ``tombstone_ms`` after its error; a later event would open the run
    anew, so the tombstone should live as long as late events can come.  ``prepare_session`` has to come first.
    """
    columns = events.select("run", "seq", "type", "stage", "status", "ms", "message", "report")
    columns = columns.withColumn("ms", F.col("ms").cast("bigint"))
    return columns.groupBy("run").transformWithStateInPandas(
        statefulProcessor=_RunFold(quiet_ms, tombstone_ms),
        outputStructType=_OUTCOME,
        outputMode="Update",
        timeMode="ProcessingTime",
    )
