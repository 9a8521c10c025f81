"""Publishing what changed, once and continuously."""

import json
import os
import shutil

import pytest
import samples
from pyspark.sql import functions as F

from reviewlake.plans import incremental
from reviewlake.sources import commits, listing, readers, writers


def state(spark, out):
    reports = {r.id: r.title for r in readers.read_published(spark, f"{out}/reports").valid.collect()}
    index = {r.id: r.issues for r in readers.read_index(spark, f"{out}/index").collect()}
    return reports, index


def spoiled(path):
    """Other text of the same size and time: whoever opens the file finds no JSON."""
    was = path.stat()
    path.write_text("!" * was.st_size)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


def test_only_changed_runs_are_opened(spark, tmp_path):
    runs, truth, out = tmp_path / "runs", tmp_path / "truth", str(tmp_path / "out")
    for name in ("a", "b", "deep/c"):
        samples.write_run(runs / os.path.dirname(name), os.path.basename(name))
    truth.mkdir()
    (truth / "a.expected.json").write_text(json.dumps(samples.truth()))
    first = incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3)
    assert first.runs == 3 and set(state(spark, out)[0]) == {"a", "b", "deep/c"}
    assert incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3) == (0, first.version)
    # One file of b changes; whatever of the others is opened from now on is no JSON.
    for path in [*(runs / "a").glob("*.json"), *(runs / "deep/c").glob("*.json"), truth / "a.expected.json"]:
        spoiled(path)
    far = samples.analysis()
    far["errors"] = far["errors"][:2]
    (runs / "b/analysis.json").write_text(json.dumps(far))
    samples.write_run(runs, "new", analysis__json="{}")
    second = incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3)
    assert second == (2, first.version + 1)
    reports, index = state(spark, out)
    assert set(reports) == set(index) == {"a", "b", "deep/c"} and index["b"] == 2 and index["a"] == 6
    assert [r.run for r in incremental.read_rejected(spark, out).collect()] == ["new"]
    # New ground truth publishes its run again, and a run that has become valid is no longer rejected.
    (runs / "new/analysis.json").write_text(json.dumps(samples.analysis()))
    (truth / "b.expected.json").write_text(json.dumps(samples.truth()))
    assert incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3).runs == 2
    assert incremental.read_rejected(spark, out).count() == 0
    valid = readers.read_published(spark, f"{out}/reports").valid
    assert {r.id for r in valid.filter("detection IS NOT NULL").collect()} == {"a", "b"}
    # A missing file rejects its run, and its report stays.
    (runs / "new/fixes.json").unlink()
    assert incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3).runs == 1
    assert [(r.run, r.detail) for r in incremental.read_rejected(spark, out).collect()] == [("new", "fixes.json")]
    shutil.rmtree(runs / "new")
    assert incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3).runs == 1
    assert incremental.publish_changed(spark, str(runs), out, str(truth), buckets=3).runs == 0
    assert set(state(spark, out)[0]) == {"a", "b", "deep/c", "new"}


@pytest.mark.parametrize("step", ["_reject", "publish_index", "publish_reports"])
def test_a_stopped_publish_is_done_by_the_next(spark, tmp_path, monkeypatch, step):
    runs, out = tmp_path / "runs", str(tmp_path / "out")
    samples.write_run(runs, "a")
    with monkeypatch.context() as patch:
        patch.setattr(incremental if step == "_reject" else writers, step, lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.publish_changed(spark, str(runs), out, buckets=2)
    assert incremental.publish_changed(spark, str(runs), out, buckets=2).runs == 1
    reports, index = state(spark, out)
    assert set(reports) == set(index) == {"a"}


def test_listing_equals_sparks_own(spark, tmp_path):
    for name in ("a", "deep er/b%20", "deep er/x/c"):
        samples.write_run(tmp_path / "runs" / os.path.dirname(name), os.path.basename(name))
    mine = listing.read_texts(listing.list_files(spark, str(tmp_path / "runs"), str(tmp_path / "staging")))
    want = readers.read_files(spark, str(tmp_path / "runs"))
    columns = ["folder", "file", "mtime", "text"]
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert mine.count() == 27
    gone = spark.createDataFrame([(str(tmp_path / "none"),)], "path string")
    assert listing.read_texts(gone).count() == 0
    assert listing.list_files(spark, str(tmp_path / "none"), str(tmp_path / "staging")).count() == 0


def test_stream_of_runs(spark, tmp_path):
    runs, out, checkpoint = tmp_path / "runs", str(tmp_path / "out"), tmp_path / "checkpoint"

    def follow():
        stream = incremental.publish_stream(spark, str(runs), out, str(checkpoint), "live", buckets=2)
        stream.trigger(availableNow=True).start().awaitTermination()
        reports, index = state(spark, out)
        assert set(reports) == set(index)
        return set(index), commits.latest(spark, f"{out}/index").version

    samples.write_run(runs, "a")
    samples.write_run(runs / "deep er", "b")
    samples.write_run(runs, "open", report__json=None)
    assert follow() == ({"a", "deep er/b"}, 1)
    (runs / "open/report.json").write_text(json.dumps(samples.summary()))
    samples.write_run(runs, "bad", analysis__json="{}")
    assert follow() == ({"a", "deep er/b", "open"}, 2)
    assert [r.run for r in incremental.read_rejected(spark, out).collect()] == ["bad"]
    # Stopped before Spark noted the batch: it comes again and changes nothing.
    for part in checkpoint.glob("commits/*1*"):
        part.unlink()
    for part in checkpoint.glob("commits/.1*"):
        part.unlink()
    assert follow() == ({"a", "deep er/b", "open"}, 2)
    # What the stream published is known to a later publish of changes.
    assert incremental.publish_changed(spark, str(runs), out, buckets=2).runs == 0


def test_a_batch_of_events_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", 1, "stage", "fix", "done", 12.5), ("a", 2, "error", None, None, None)]
    events = spark.createDataFrame(rows, "run string, seq bigint, type string, stage string, status string, ms double")
    events = events.withColumn("ts", F.timestamp_millis("seq"))
    for batch in (0, 0, 1):
        writers.write_events(events.filter(F.col("seq") == batch + 1), path, batch=batch)
    assert sorted(r.seq for r in readers.read_event_lines(spark, path).collect()) == [1, 2]
