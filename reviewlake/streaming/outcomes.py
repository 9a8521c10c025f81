"""Run outcomes as a stream with a running fold: work per event does not depend on how long its run is.

The state of a run is what its events say up to the first gap in their numbers: last status and time of each stage,
the last report, how many were read, and the number that comes next.  Only events behind a gap are kept themselves, until it
closes.  Nothing before the fold can come any more, so nothing is ever taken back; behind the first known error nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewlake.schemas import STAGES
from reviewlake.streaming.progress import PENDING, first_errors

_STAGES = ", ".join(f"{s}_status string, {s}_ms bigint" for s in STAGES)
# What a run's events say so far.
FOLD = f"next bigint, read bigint, report string, done boolean, {_STAGES}"
STATE = f"run string, {FOLD}, stop bigint, message string"
OUTCOME = "run string, outcome string, message string, report string, events_read bigint, stages string, ignored bigint"
_EVENT = "after bigint, type string, stage string, status string, ms bigint, message string, report string"
_NAMES = [f.split(" ")[0] for f in FOLD.split(", ")]
_AT = {n: i for i, n in enumerate(_NAMES)}


def folded(fold: list, event) -> list:
    """The fold with one more event (after, type, stage, status, ms, message, report) that is no error."""
    after, kind, stage, status, ms, _, report = event
    out = list(fold)
    out[_AT["next"]] = after
    if kind is None:
        return out  # a place without an event
    out[_AT["read"]] += 1
    if kind == "result":
        out[_AT["report"]], out[_AT["done"]] = report, True
    elif kind == "stage" and stage in STAGES:
        out[_AT[f"{stage}_status"]] = status
        if ms is not None:
            out[_AT[f"{stage}_ms"]] = ms
    return out


class _RunningFold(StatefulProcessor):
    def __init__(self, first: int, quiet_ms: int, stopped_ms: int):
        self.first, self.quiet_ms, self.stopped_ms = first, quiet_ms, stopped_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", FOLD, ttlDurationMs=self.quiet_ms)
        self.behind = handle.getMapState("behind", "seq bigint", _EVENT, ttlDurationMs=self.quiet_ms)
        self.stop = handle.getValueState("stop", "seq bigint, message string, final boolean", ttlDurationMs=self.stopped_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.fold.update(tuple(initialState[n] for n in _NAMES))
        if initialState["stop"] is not None:
            self.stop.update((initialState["stop"], initialState["message"], True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        nothing = [self.first, 0, None, False, *[None] * (2 * len(STAGES))]
        fold = list(self.fold.get()) if self.fold.exists() else nothing
        stop = tuple(self.stop.get()) if self.stop.exists() else None
        was, ignored, waits = stop, 0, False
        for e in rows:
            event = (e.after, e.type, e.stage, e.status, e.ms, e.message, e.report)
            if e.seq < fold[0] or stop is not None and (stop[2] or e.seq >= stop[0]):
                ignored += 1  # known already, or behind the error
            elif e.seq == fold[0] and e.type != "error":
                fold = folded(fold, event)
            else:
                if e.type == "error":
                    stop = (e.seq, e.message, False)
                self.behind.updateValue((e.seq,), event)
                waits = True
        # What the gap was waiting for may be there now.
        while not (stop and stop[2]) and self.behind.containsKey((fold[0],)):
            seq = (fold[0],)
            event = tuple(self.behind.getValue(seq))
            self.behind.removeKey(seq)
            if event[1] == "error":
                fold[0] = event[0]
                stop = (seq[0], event[5], True)
            else:
                fold = folded(fold, event)
        if stop is not None and stop != was:
            self.stop.update(stop)
        self.fold.update(tuple(fold))
        seen = fold
        kept = []
        if waits or self.behind.exists():
            for seq, event in list(self.behind.iterator()):
                if seq[0] < fold[0] or stop is not None and seq[0] > stop[0]:
                    self.behind.removeKey(seq)
                elif event[1] != "error":
                    kept.append((seq[0], tuple(event)))
        for _, event in sorted(kept):
            seen = folded(seen, event)
        at = dict(zip(_NAMES, seen))
        stages = ",".join(f"{at[f'{s}_status'] or PENDING}:{'' if at[f'{s}_ms'] is None else at[f'{s}_ms']}" for s in STAGES)
        outcome = "error" if stop is not None else "result" if at["done"] else "open"
        message = None if stop is None else stop[1]
        yield Row(
            run=key[0], outcome=outcome, message=message, report=at["report"], events_read=at["read"] + (stop is not None),
            stages=stages, ignored=ignored,
        )

    def close(self) -> None:
        pass


def run_states(events: DataFrame, after: Column | None = None) -> DataFrame:
    """The folds of a batch of events, to start a stream from: one row per run, STATE.

    Each run's events are whole up to the last one; ``after`` is the number that follows an event's, seq + 1 by default.
    """
    after = F.col("seq") + 1 if after is None else after
    stops = first_errors(events).select("run", F.col("error_seq").alias("stop"), "message")
    here = events.drop("message").withColumn("_after", after).join(stops, "run", "left")
    before = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    seq = F.when(before, F.col("seq"))
    stages = []
    for s in STAGES:
        mine = before & (F.col("type") == "stage") & (F.col("stage") == s)
        stages.append(F.max_by("status", F.when(mine, F.col("seq"))).alias(f"{s}_status"))
        stages.append(F.max_by(F.col("ms").cast("bigint"), F.when(mine & F.col("ms").isNotNull(), F.col("seq"))).alias(f"{s}_ms"))
    result = F.col("type") == "result"
    return here.groupBy("run").agg(
        F.max(F.when(before | (F.col("seq") == F.col("stop")), F.col("_after"))).alias("next"),
        F.count_if(before & F.col("type").isNotNull()).alias("read"),
        F.max_by("report", F.when(result, seq)).alias("report"),
        F.coalesce(F.max(result & before), F.lit(False)).alias("done"),
        *stages, F.max("stop").alias("stop"), F.max("message").alias("message"),
    )


def fold_runs(
    events: DataFrame, quiet_ms: int, stopped_ms: int, after: Column | None = None, first: int = 0, start: DataFrame | None = None
) -> DataFrame:
    """Streaming run outcomes, one updated row per run and micro-batch, as ``run_outcome`` has them over the events so far.

    Events may come in any order and more than once; ``ignored`` counts those of the batch that were known already or lie
    behind the run's first error.  Numbers are dense, or ``after`` gives the number that follows an event's (for a log by
    bytes: the end of its line); ``first`` is the first number of a run.  A row without a type only fills its place.  Events
    behind a gap are kept until it closes.  ``start`` has states as ``run_states`` gives them, read when the stream first
    starts.  A run without news for ``quiet_ms`` is forgotten, a stopped one after ``stopped_ms``, and counts as new then.
    ``progress.prepare_session`` has to come first.
    """
    after = F.col("seq") + 1 if after is None else after
    rows = events.select(
        F.col("run").cast("string").alias("run"), F.col("seq").cast("bigint").alias("seq"), after.cast("bigint").alias("after"),
        "type", "stage", "status", F.col("ms").cast("bigint").alias("ms"), "message", "report",
    )
    if start is not None:
        start = start.select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in STATE.split(", "))]).groupBy("run")
    return rows.groupBy("run").transformWithState(
        statefulProcessor=_RunningFold(first, quiet_ms, stopped_ms),
        outputStructType=OUTCOME,
        outputMode="Update",
        timeMode="ProcessingTime",
        initialState=start,
    )
