"""The first valid attempt of a stage as a stream: decided as soon as it can be, or when the watermark says no more will come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewlake.operators.timing import MAX_ATTEMPTS

_ATTEMPT = "result string, error string, started bigint, ended bigint"
OUTCOME = "run string, stage string, attempt int, result string, error string, elapsed_ms bigint"


def outcome(known: dict[int, tuple]) -> tuple:
    """attempt, result, error, elapsed_ms of the attempts (result, error, started, ended), as ``first_valid_attempt`` has them."""
    valid = [k for k in sorted(known) if known[k][1] is None]
    ended = known[valid[0]][3] if valid else max(a[3] for a in known.values())
    elapsed = (ended - min(a[2] for a in known.values()) + 500) // 1000
    if valid:
        return valid[0], known[valid[0]][0], None, elapsed
    return None, None, known[max(known)][1], elapsed


def decided(known: dict[int, tuple]) -> bool:
    """Can no further attempt change the outcome?  The first valid one counts, and there are no more than MAX_ATTEMPTS."""
    for k in range(1, MAX_ATTEMPTS + 1):
        if k not in known:
            return False
        if known[k][1] is None:
            return True
    return True


class _FirstValid(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getMapState("attempts", "attempt int", _ATTEMPT)
        self.closed = handle.getValueState("closed", "closed boolean")

    def _known(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.attempts.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, latest = self.closed.exists(), None
        for r in rows:
            if not closed and not self.attempts.containsKey((r.attempt,)):
                self.attempts.updateValue((r.attempt,), (r.result, r.error, r.started, r.ended))
                latest = max(latest or 0, r.ended // 1000 + self.wait_ms)
        if latest is None:
            return
        # The state of a stage goes when the watermark passes this, decided or not.
        self.handle.registerTimer(latest)
        known = self._known()
        if decided(known):
            self.closed.update((True,))
            yield Row(run=key[0], stage=key[1], **dict(zip(("attempt", "result", "error", "elapsed_ms"), outcome(known))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._known()
        if not known or max(a[3] for a in known.values()) // 1000 + self.wait_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # a later attempt has a later timer
        if not self.closed.exists():
            yield Row(run=key[0], stage=key[1], **dict(zip(("attempt", "result", "error", "elapsed_ms"), outcome(known))))
        self.attempts.clear()
        self.closed.clear()

    def close(self) -> None:
        pass


def follow_attempts(attempts: DataFrame, wait_ms: int, delay: str) -> DataFrame:
    """Streaming ``first_valid_attempt`` over attempts(run, stage, attempt, result, error, started, ended): a row per decided stage.

    A stage is decided by its first valid attempt once the ones before it are known, or by the last that may be made.
    If one never comes, the stage is closed with what is known when the watermark, ``delay`` behind the newest end of
    an attempt, is ``wait_ms`` past its own last end.  Attempts come in any order and more than once; times are in
    microseconds, and attempts of a stage follow each other.  Rows later than the watermark are not counted.
    ``progress.prepare_session`` has to come first.
    """
    rows = attempts.filter(F.col("attempt") <= MAX_ATTEMPTS).select(
        F.col("run").cast("string").alias("run"), "stage", F.col("attempt").cast("int").alias("attempt"),
        F.col("result").cast("string").alias("result"), "error", "started", "ended", F.timestamp_micros("ended").alias("at"),
    )
    return rows.withWatermark("at", delay).groupBy("run", "stage").transformWithState(
        statefulProcessor=_FirstValid(wait_ms), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime"
    )
