"""Files that grow between micro-batches, against one whole read."""

import json
import random

import pytest

from reviewlake.sources import growing, readers


def events(n, tag):
    kinds = [{"type": "stage", "stage": "fix", "status": "running"}, {"type": "error", "message": f"{tag} é  x"}, {"type": "result", "report": {"id": tag}}]
    return [json.dumps(kinds[i % 3] | {"ms": i}, ensure_ascii=False) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("run", "seq", "type", "stage", "ms", "message", "report").collect()), key=repr)


class Follower:
    """The stream, run over what is there, from its checkpoint; each time as after a restart."""

    def __init__(self, spark, path, tmp_path, per_task):
        self.spark, self.path, self.per_task = spark, str(path), per_task
        self.out, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def follow(self):
        df = growing.read_growing_events(self.spark, self.path, per_task=self.per_task)
        writer = df.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(self.out)


@pytest.mark.parametrize("per_task", [7, 1 << 20])
def test_a_file_appended_in_pieces_is_one_whole_read(spark, tmp_path, per_task):
    logs = tmp_path / "logs"
    (logs / "deep").mkdir(parents=True)
    texts = {
        "a.ndjson": "\n".join(events(9, "a")) + "\n\n" + events(1, "last")[0] + "\n",
        "deep/b.ndjson": "\n".join(events(5, "b")) + "\nno json\n" + '{"type": "cut off',
        "late.ndjson": "\n".join(events(3, "late")) + "\n",
    }
    (logs / "other.txt").write_text("not followed\n")
    follower = Follower(spark, logs, tmp_path, per_task)
    rng = random.Random(per_task)
    seen = 0
    for piece in range(5):
        for name, text in texts.items():
            if name == "late.ndjson" and piece < 2:
                continue
            data = text.encode()
            there = (logs / name).read_bytes() if (logs / name).exists() else b""
            # Pieces end anywhere, also inside a character.
            upto = len(data) if piece == 4 else rng.randint(len(there), len(data))
            (logs / name).write_bytes(data[:upto])
        count = follower.follow().count()
        assert count >= seen
        seen = count
    found = follower.follow()
    assert rows(found) == rows(growing.read_growing_events(spark, str(logs), stream=False))
    # The reader of whole files gives the same events, numbered by line.
    (logs / "deep/b.ndjson").rename(logs / "b.ndjson")
    whole = readers.read_event_files(spark, str(logs)).orderBy("run", "seq")
    mine = found.orderBy("run", "seq").collect()
    assert [(r.run.rpartition("/")[2], r.type, r.ms, r.message, r.report) for r in mine if "/" not in r.run] == [
        (r.run, r.type, r.ms, r.message, r.report) for r in whole.collect() if r.run != "b"
    ]
    assert [(r.type, r.message) for r in mine if r.run == "deep/b"] == [(r.type, r.message) for r in whole.collect() if r.run == "b"]


def test_each_batch_reads_only_what_is_new(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 16)
    path = tmp_path / "x.ndjson"
    path.write_bytes(b"first line\nsecond line is a long one\nthird")
    reader = growing._Growing({"path": str(tmp_path), "bytesPerTask": 10})
    assert reader.latestOffset() == {"x.ndjson": 42}
    spans = reader.partitions({"x.ndjson": 20}, {"x.ndjson": 42, "gone.ndjson": 0})
    assert [s for p in spans for s in p.spans] == [("x.ndjson", 20, 30), ("x.ndjson", 30, 40), ("x.ndjson", 40, 42)]
    with open(path, "rb") as file:
        assert list(growing.lines_ending_in(file, 20, 42)) == [(11, b"second line is a long one")]
        for cut in range(1, 42):
            both = [*growing.lines_ending_in(file, 0, cut), *growing.lines_ending_in(file, cut, 42)]
            assert both == [(0, b"first line"), (11, b"second line is a long one")]


def test_nothing_there(spark, tmp_path):
    assert growing.read_growing_events(spark, str(tmp_path / "none"), stream=False).count() == 0
    (tmp_path / "e.ndjson").write_text("")
    assert Follower(spark, tmp_path, tmp_path, 100).follow().count() == 0
