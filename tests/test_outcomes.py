"""The running fold against the batch, for any cut of the events."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import LONG, STAGES, as_log, random_events, run_stream, stage, table

from reviewlake.sources import readers
from reviewlake.streaming import outcomes, progress


def expected(log):
    states = {}
    for s in progress.stage_state(progress.until_first_error(log)).collect():
        states.setdefault(s.run, {})[s.stage] = f"{s.status}:{'' if s.ms is None else s.ms}"
    return {
        r.run: (*tuple(r)[1:], ",".join(states.get(r.run, {}).get(s, "pending:") for s in STAGES))
        for r in progress.run_outcome(log).collect()
    }


def last_rows(emitted):
    got = {}
    for _, row in sorted(emitted, key=lambda e: e[0]):
        got[row.run] = (row.outcome, row.message, row.report, row.events_read, row.stages)
    return got


@pytest.mark.parametrize("cut", ["one", "ordered", "shuffled"])
def test_fold_equals_batch_after_every_batch(spark, tmp_path, cut):
    session = progress.prepare_session(spark.newSession())
    rows = random_events(7)
    random.Random(5).shuffle(rows)
    place = {
        "one": lambda r: 0,
        "ordered": lambda r: min(2, r[1] // 4),
        "shuffled": lambda r: random.Random(str(r[:2])).randrange(3),
    }[cut]
    as_log(session, rows, str(tmp_path / "log"), place)
    streamed = readers.read_event_lines(session, str(tmp_path / "log"), stream=True, per_batch=1)
    emitted = run_stream(session, outcomes.fold_runs(streamed, LONG, LONG), tmp_path, "update")
    for number in sorted({n for n, _ in emitted}):
        so_far = table(session, [r for r in rows if place(r) <= number])
        assert last_rows([e for e in emitted if e[0] <= number]) == expected(so_far)


def test_a_stream_started_from_a_batch(spark, tmp_path):
    session = progress.prepare_session(spark.newSession())
    rows = random_events(8)
    early = [r for r in rows if r[1] < 5]
    late = [r for r in rows if r[1] >= 3]  # some come again
    as_log(session, late, str(tmp_path / "log"), lambda r: r[1] % 2)
    streamed = readers.read_event_lines(session, str(tmp_path / "log"), stream=True, per_batch=1)
    start = outcomes.run_states(table(session, early))
    emitted = run_stream(session, outcomes.fold_runs(streamed, LONG, LONG, start=start), tmp_path, "update")
    want = expected(table(session, rows))
    got = last_rows(emitted)
    assert got == {run: want[run] for run in got} and len(got) >= 8
    known = {r[:2] for r in early} & {r[:2] for r in late}
    assert sum(row.ignored for _, row in emitted) >= len(known) > 0


def test_work_does_not_grow_with_the_run():
    """The fold of a long run is as small as that of a short one, and events in order are never kept."""
    fold = [0, 0, None, False, *[None] * (2 * len(STAGES))]
    for n in range(1000):
        fold = outcomes.folded(fold, (n + 1, "stage", STAGES[n % 4], "done", n, None, None))
    assert fold[:4] == [1000, 1000, None, False] and len(fold) == 4 + 2 * len(STAGES)
    assert outcomes.folded(fold, (1001, None, None, None, None, None, None))[:2] == [1001, 1000]


def test_numbers_by_bytes(spark, tmp_path):
    """Events numbered by the byte they begin at, given the byte after them; a gap waits, an error in it counts."""
    session = progress.prepare_session(spark.newSession())
    rows = [stage("a", 0, "fix", "running"), stage("a", 10, "fix", "done", 4), ("a", 30, "error", None, None, None, "x", None), stage("a", 55, "fix", "error")]
    order = {55: 0, 30: 1, 0: 2, 10: 3}
    as_log(session, rows, str(tmp_path / "log"), lambda r: order[r[1]])
    streamed = readers.read_event_lines(session, str(tmp_path / "log"), stream=True, per_batch=1)
    after = F.when(F.col("seq") == 0, 10).when(F.col("seq") == 10, 30).otherwise(55)
    emitted = run_stream(session, outcomes.fold_runs(streamed, LONG, LONG, after=after), tmp_path, "update")
    seen = [(r.outcome, r.events_read, r.stages.split(",")[1]) for _, r in sorted(emitted, key=lambda e: e[0])]
    assert seen == [("open", 1, "error:"), ("error", 1, "pending:"), ("error", 2, "running:"), ("error", 3, "done:4")]
