"""Attempts as a stream against the batch."""

import itertools
import random

from test_streaming import run_stream

from reviewlake.operators import timing
from reviewlake.streaming import attempts, progress

DDL = "run string, stage string, attempt int, result string, error string, started bigint, ended bigint"
START = 1_790_000_000_000_000


def made(rng, runs=12):
    rows = []
    for i in range(runs):
        for stage in ("analyze", "fix"):
            at = START + i * 10_000_000
            for n in range(1, rng.randint(1, 4)):
                bad = rng.random() < 0.6
                end = at + rng.randint(1, 3_000_000)
                rows.append((f"r{i}", stage, n, None if bad else f"v{n}", f"e{n}" if bad else None, at, end))
                at = end + rng.randint(0, 1000)
    return rows


def test_outcome_is_that_of_the_batch(spark):
    rows = made(random.Random(1), 40)
    want = {(r.run, r.stage): tuple(r)[2:] for r in timing.first_valid_attempt(spark.createDataFrame(rows, DDL)).collect()}
    of = {}
    for run, stage, n, *rest in rows:
        if n <= timing.MAX_ATTEMPTS:
            of.setdefault((run, stage), {})[n] = tuple(rest)
    assert {k: attempts.outcome(known) for k, known in of.items()} == want
    # Once decided, no other attempt changes it.
    for known in of.values():
        for some in itertools.chain.from_iterable(itertools.combinations(known, n) for n in range(1, len(known) + 1)):
            part = {k: known[k] for k in some}
            if attempts.decided(part):
                assert attempts.outcome(part) == attempts.outcome(known)


def test_stream_equals_batch(spark, tmp_path):
    session = progress.prepare_session(spark.newSession())
    rng = random.Random(6)
    rows = made(rng)
    rows += rng.choices(rows, k=6)  # some come twice
    place = {r[:3]: rng.randrange(3) for r in rows}
    late = START + 10_000_000_000
    ends = [("end", "fix", 1, "x", None, late, late)], [("end", "test", 1, "x", None, late * 2 - START, late * 2 - START)], [("end", "report", 1, "x", None, late, late)]
    log = str(tmp_path / "log")
    for n, part in enumerate([*([r for r in rows if place[r[:3]] == i] for i in range(3)), *ends]):
        session.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(log)
    stream = session.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(log)
    emitted = run_stream(session, attempts.follow_attempts(stream, 60_000, "1 hour"), tmp_path, "append")
    batch = timing.first_valid_attempt(spark.createDataFrame(rows, DDL).distinct())
    want = {(r.run, r.stage): tuple(r)[2:] for r in batch.collect()}
    got = [((r.run, r.stage), tuple(r)[2:]) for _, r in emitted if r.run != "end"]
    assert len(got) == len(want) and dict(got) == want
    # What needed no waiting did not wait for the watermark, and the rest did.
    early = {(r.run, r.stage) for n, r in emitted if n < 3 and r.run != "end"}
    of = {}
    for run, stage, n, *rest in rows:
        if n <= timing.MAX_ATTEMPTS:
            of.setdefault((run, stage), {})[n] = tuple(rest)
    assert early == {k for k, known in of.items() if attempts.decided(known)} and early != set(want)
