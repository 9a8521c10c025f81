import json
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.schemas import STAGES
from reviewlake.sources import readers, writers
from reviewlake.streaming import progress

START = 1_790_000_000
DDL = (
    "run string, seq bigint, type string, stage string, status string, ms bigint, "
    "message string, report string, ts timestamp, started_at timestamp"
)


def table(spark, rows):
    """rows of (run, seq, type, stage, status, ms, message, report); times follow seq."""
    return spark.createDataFrame(rows, DDL.split(", ts")[0]).withColumns(
        {"ts": F.timestamp_millis(F.col("seq") * 1500), "started_at": F.timestamp_seconds(F.lit(START))}
    )


def stage(run, seq, name, status, ms=None):
    return (run, seq, "stage", name, status, ms, None, None)


STORY = [
    stage("a", 0, "analyze", "running"),
    stage("a", 1, "analyze", "done", 1200),
    stage("a", 2, "fix", "running"),
    stage("a", 3, "fix", "error"),
    ("a", 4, "error", None, None, None, "fix stage failed", None),
    stage("a", 5, "fix", "done", 7),
    ("a", 6, "result", None, None, None, None, "late"),
    ("a", 7, "error", None, None, None, "again", None),
    stage("b", 0, "analyze", "running"),
    stage("b", 2, "analyze", "done", 5),
    stage("b", 3, "analyze", "running"),
    ("b", 4, "result", None, None, None, None, "one"),
    ("b", 5, "result", None, None, None, None, "two"),
    stage("c", 0, "report", "error"),
]


def test_state_keeps_the_last_known_duration(spark):
    rows = {(r.run, r.stage): (r.status, r.ms) for r in progress.stage_state(table(spark, STORY)).collect()}
    assert rows == {
        ("a", "analyze"): ("done", 1200), ("a", "fix"): ("done", 7),
        ("b", "analyze"): ("running", 5), ("c", "report"): ("error", None),
    }


def test_reading_stops_at_the_first_error(spark):
    seen = progress.until_first_error(table(spark, STORY))
    rows = {(r.run, r.stage): (r.status, r.ms) for r in progress.stage_state(seen).collect()}
    assert rows["a", "fix"] == ("error", None) and rows["b", "analyze"] == ("running", 5)
    outcomes = {r.run: tuple(r)[1:] for r in progress.run_outcome(table(spark, STORY)).collect()}
    assert outcomes == {
        "a": ("error", "fix stage failed", None, 5),
        "b": ("result", None, "two", 5),
        # A failed stage alone does not end a run.
        "c": ("open", None, None, 1),
    }


def test_elapsed_includes_the_retry(spark):
    rows = {(r.run, r.stage): r.elapsed_ms for r in progress.stage_elapsed(table(spark, STORY)).collect()}
    assert rows == {("a", "analyze"): 1500, ("a", "fix"): 4500, ("b", "analyze"): 3000, ("c", "report"): None}


def test_progress_shows_every_stage(spark):
    rows = progress.stage_progress(table(spark, STORY)).filter("run = 'a'").orderBy("stage_no").collect()
    assert [(r.stage, r.status, r.seconds) for r in rows] == [
        ("analyze", "done", "1.2s"), ("fix", "done", "0.0s"), ("test", "pending", None), ("report", "pending", None),
    ]


def random_events(seed):
    rng = random.Random(seed)
    rows = []
    for run in [f"r{i}" for i in range(12)] + ["hot"]:
        for seq in range(120 if run == "hot" else rng.randrange(1, 12)):
            kind = rng.random()
            if kind < 0.05:
                rows.append((run, seq, "error", None, None, None, f"m{seq}", None))
            elif kind < 0.15:
                rows.append((run, seq, "result", None, None, None, None, json.dumps({"n": seq}, separators=(",", ":"))))
            else:
                status = rng.choice(["running", "done", "error"])
                rows.append(stage(run, seq, rng.choice(STAGES), status, seq if status == "done" else None))
    return rows


def as_log(spark, rows, path, batches):
    """Write the rows as event files, one micro-batch each; ``batches`` maps a row to its batch."""
    log = table(spark, rows)
    for number in sorted({batches(r) for r in rows}):
        part = table(spark, [r for r in rows if batches(r) == number])
        writers.write_events(part.coalesce(1), path)
    return log


def run_stream(spark, df, tmp_path, mode):
    """Run to the end and return the emitted rows with their batch."""
    out = []

    def keep(batch, number):
        out.extend((number, row) for row in batch.collect())

    query = (
        df.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180) and query.exception() is None
    return out


def test_streamed_progress_equals_batch(spark, tmp_path):
    rows = random_events(1)
    shuffled = {(r[0], r[1]): random.Random(str(r[:2])).randrange(3) for r in rows}
    log = as_log(spark, rows, str(tmp_path / "log"), lambda r: shuffled[r[:2]])
    streamed = readers.read_event_lines(spark, str(tmp_path / "log"), stream=True, per_batch=1)
    got = {}
    for number, row in run_stream(spark, progress.watch_progress(streamed, "6 hours"), tmp_path, "update"):
        got[row.run, row.stage] = (row.status, row.seconds)
    expected = {(r.run, r.stage): (r.status, r.seconds) for r in progress.stage_progress(log).collect()}
    assert got == expected and len(got) == 13 * 4


LONG = 10**12


@pytest.mark.parametrize("cut", ["one", "ordered", "shuffled"])
def test_followed_runs_equal_batch(spark, tmp_path, cut):
    """However the events are cut into files, micro-batches and Arrow batches, and in any order."""
    session = progress.prepare_session(spark.newSession())
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    rows = random_events(2)
    random.Random(4).shuffle(rows)
    place = {
        "one": lambda r: 0,
        "ordered": lambda r: min(2, r[1] // 4),
        "shuffled": lambda r: random.Random(str(r[:2])).randrange(4),
    }[cut]
    log = as_log(session, rows, str(tmp_path / "log"), place)
    streamed = readers.read_event_lines(session, str(tmp_path / "log"), stream=True, per_batch=1)
    got = {}
    emitted = run_stream(session, progress.follow_runs(streamed, LONG, LONG), tmp_path, "update")
    for _, row in sorted(emitted, key=lambda e: e[0]):
        got[row.run] = row
    states = {}
    for s in progress.stage_state(progress.until_first_error(log)).collect():
        states.setdefault(s.run, {})[s.stage] = f"{s.status}:{'' if s.ms is None else s.ms}"
    for r in progress.run_outcome(log).collect():
        mine = got.pop(r.run)
        assert (mine.outcome, mine.message, mine.report, mine.events_read) == tuple(r)[1:]
        seen = states.get(r.run, {})
        assert mine.stages.split(",") == [seen.get(s, "pending:") for s in STAGES]
    assert not got


def test_progress_is_the_same_beside_followed_runs(spark, tmp_path):
    """The state settings of follow_runs change nothing for a plain aggregation."""
    session = progress.prepare_session(spark.newSession())
    log = as_log(session, random_events(6), str(tmp_path / "log"), lambda r: r[1] % 2)
    streamed = readers.read_event_lines(session, str(tmp_path / "log"), stream=True, per_batch=1)
    got = {}
    for _, row in run_stream(session, progress.watch_progress(streamed, "6 hours"), tmp_path, "update"):
        got[row.run, row.stage] = (row.status, row.seconds)
    assert got == {(r.run, r.stage): (r.status, r.seconds) for r in progress.stage_progress(log).collect()}


def test_old_runs_leave_the_state(spark, tmp_path):
    rows = [stage("old", 0, "fix", "running"), stage("new", 1, "fix", "running")]
    path = str(tmp_path / "log")
    early = table(spark, rows[:1])
    late = table(spark, rows[1:]).withColumn("started_at", F.timestamp_seconds(F.lit(START + 100_000)))
    for part in (early, late, late.withColumn("run", F.lit("newer")), early.withColumn("run", F.lit("too late"))):
        writers.write_events(part.coalesce(1), path)
    streamed = readers.read_event_lines(spark, path, stream=True, per_batch=1)
    seen = {row.run for _, row in run_stream(spark, progress.watch_elapsed(streamed, "1 hour"), tmp_path, "update")}
    assert seen == {"old", "new", "newer"}


def test_events_are_passed_on(spark, tmp_path):
    rows = random_events(3)
    log = as_log(spark, rows, str(tmp_path / "log"), lambda r: r[1] % 2)
    streamed = readers.read_event_lines(spark, str(tmp_path / "log"), stream=True)
    writer = writers.stream_events(streamed, str(tmp_path / "copy"), str(tmp_path / "checkpoint"))
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    columns = ["run", "seq", "type", "stage", "status", "ms", "message", "report", "ts", "started_at"]
    back = readers.read_event_lines(spark, str(tmp_path / "copy")).withColumn("ms", F.col("ms").cast("bigint"))
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, log.select(*columns).collect()))
