"""The index in ranges: little is rewritten, and nothing is lost by stops or other publishers."""

import json

import pytest
from pyspark.sql import functions as F

from reviewlake.schemas import INDEX_ENTRY
from reviewlake.sources import commits, index_store, readers, writers


def entries(spark, ids, issues=0):
    return spark.createDataFrame([(i, "f.ts", f"t{issues}", None, issues) for i in ids], INDEX_ENTRY)


def ids_of(spark, path):
    return {r.id: r.issues for r in readers.read_index(spark, path).collect()}


def folders(spark, path):
    return [p.folder for p in commits.latest(spark, path).parts]


def names(n):
    return [f"{'aAbBcCéÉzZ'[i % 10]}-run {i:05d}" for i in range(n)]


def test_a_small_publish_rewrites_few_ranges(spark, tmp_path):
    path = str(tmp_path / "index")
    ids = names(4000)
    writers.publish_index(entries(spark, ids), path, "recordedAt", per_range=100)
    before = commits.latest(spark, path)
    assert 20 <= len(before.parts) <= 80 and sum(p.rows for p in before.parts) == 4000
    some = [ids[7], ids[1234], "b-new", "", "zzz", "É-new"]
    writers.publish_index(entries(spark, some, issues=3), path, "recordedAt", per_range=100)
    after = commits.latest(spark, path)
    kept = {p.folder for p in before.parts} & {p.folder for p in after.parts}
    assert len(kept) >= len(before.parts) - len(some)
    assert ids_of(spark, path) == {**{i: 0 for i in ids}, **{i: 3 for i in some}}
    # Order within and across ranges is that of people.
    key = spark.createDataFrame([(i,) for i in [*ids, *some]], "id string").distinct()
    want = [r.id for r in key.orderBy(F.collate("id", "UNICODE"), "id").collect()]
    lines = [x for f in folders(spark, path) for p in sorted((tmp_path / "index" / f).glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == want
    # Every id is where its range says.
    parts = after.parts
    placed = key.withColumn("range", index_store.range_of([p.first for p in parts[1:]])).groupBy("range").count().collect()
    assert {r["range"]: r["count"] for r in placed} == {i: p.rows for i, p in enumerate(parts) if p.rows}


def test_large_ranges_are_split(spark, tmp_path):
    path = str(tmp_path / "index")
    writers.publish_index(entries(spark, names(50)), path, per_range=100)
    assert len(folders(spark, path)) == 1
    writers.publish_index(entries(spark, [f"m{i:04d}" for i in range(900)]), path, per_range=100)
    assert 5 <= len(folders(spark, path)) <= 20
    assert len(ids_of(spark, path)) == 950


@pytest.mark.parametrize("step", ["write", "commit", "put", "clean"])
def test_a_stop_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    writers.publish_index(entries(spark, ["a", "b"]), path)
    writers.publish_index(entries(spark, ["c"]), path)

    def stop(*_, **__):
        raise KeyboardInterrupt

    place = {"write": (index_store, "_written"), "commit": (commits, "commit"), "put": (commits, "put_if_absent"), "clean": (commits, "clean")}
    with monkeypatch.context() as patch:
        patch.setattr(*place[step], stop)
        with pytest.raises(KeyboardInterrupt):
            writers.publish_index(entries(spark, ["d"]), path)
    want = {"a", "b", "c", *(["d"] if step == "clean" else [])}
    assert set(ids_of(spark, path)) == want
    # Half a commit file is no commit.
    (tmp_path / "index/_commits/.000000000009.json-x").write_text('{"par')
    writers.publish_index(entries(spark, ["d", "e"]), path)
    assert set(ids_of(spark, path)) == {"a", "b", "c", "d", "e"}


def test_no_publisher_loses_an_entry(spark, tmp_path, monkeypatch):
    """Another one commits between this one's read and its commit, twice."""
    path = str(tmp_path / "index")
    writers.publish_index(entries(spark, ["a"]), path)
    commit, others = commits.commit, iter(["x", "y"])

    def late(session, where, new):
        other = next(others, None)
        if other:
            monkeypatch.setattr(commits, "commit", commit)
            writers.publish_index(entries(session, [other]), where)
            monkeypatch.setattr(commits, "commit", late)
        return commit(session, where, new)

    monkeypatch.setattr(commits, "commit", late)
    writers.publish_index(entries(spark, ["b"]), path)
    assert set(ids_of(spark, path)) == {"a", "b", "x", "y"}
    # Replacing the whole index is refused instead: it was derived from what is no longer current.
    others = iter(["z"])
    with pytest.raises(index_store.Taken):
        writers.write_index(readers.read_index(spark, path), path)
    assert set(ids_of(spark, path)) == {"a", "b", "x", "y", "z"}


def test_a_batch_is_published_once(spark, tmp_path):
    path = str(tmp_path / "index")
    for batch, issues in ((0, 1), (1, 2), (1, 9), (0, 9)):
        writers.publish_index(entries(spark, ["a"], issues), path, writer="stream", batch=batch)
    writers.publish_index(entries(spark, ["b"], 5), path, writer="other", batch=0)
    assert ids_of(spark, path) == {"a": 2, "b": 5}


def test_older_forms_are_kept(spark, tmp_path):
    old = tmp_path / "versions"
    for version, ids in ((1, ["a"]), (2, ["a", "b"])):
        entries(spark, ids).write.json(str(old / f"version={version}"))
    (old / "version=3").mkdir()  # was never finished
    (old / "_current").unlink(missing_ok=True)  # the pointer is gone
    assert set(ids_of(spark, str(old))) == {"a", "b"}
    one = tmp_path / "list"
    one.mkdir()
    (one / "index.json").write_text(json.dumps([{"id": "a", "fileName": "f", "recordedAt": "t", "issues": 2}, {"id": "b", "fileName": "f", "recordedAt": "t", "issues": 2}]))
    for path in (old, one):
        writers.publish_index(entries(spark, ["c"], 1), str(path))
        assert set(ids_of(spark, str(path))) == {"a", "b", "c"}


def test_unused_folders_go(spark, tmp_path):
    path = str(tmp_path / "index")
    for i in range(4):
        writers.publish_index(entries(spark, [f"a{i}"]), path)
    (tmp_path / "index/data-dead").mkdir()
    assert len(list((tmp_path / "index/_commits").glob("0*"))) == 2
    commits.clean(spark, path)
    assert (tmp_path / "index/data-dead").exists()  # perhaps still being written
    commits.clean(spark, path, orphan_ms=-10_000)
    assert not (tmp_path / "index/data-dead").exists()
    assert set(ids_of(spark, path)) == {"a0", "a1", "a2", "a3"}


def test_a_publish_computes_its_entries_twice_at_most(spark, tmp_path):
    """Once to find the ranges, once to write; what is staged in between is removed."""
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = entries(spark, names(300)).mapInArrow(count, INDEX_ENTRY)
    writers.publish_index(counted, path, "recordedAt", per_range=100)
    assert seen.value <= 2 * 300
    assert len(ids_of(spark, path)) == 300
    assert {n for n in commits.names_in(spark, path) if n.startswith("data-")} == {f.split("/")[0] for f in folders(spark, path)}
