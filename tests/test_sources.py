import json
import os

import pytest
import samples
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators import assembly
from reviewlake.plans import prompts, publish
from reviewlake.sources import readers, writers

START_MS = 1_933_135_628_250  # the sample's startedAt


def stamp(folder, **offsets):
    """Set file times to start + offset milliseconds."""
    for file, ms in offsets.items():
        at = (START_MS + ms) * 1_000_000
        os.utime(folder / file.replace("__", "."), ns=(at, at))


def test_read_runs(spark, tmp_path):
    samples.write_run(tmp_path / "deep er", "cart")
    samples.write_run(tmp_path, "a%20b", ".js")
    stamp(tmp_path / "a%20b", report__json=98)
    (tmp_path / "cart.bin").write_bytes(b"\xff")
    samples.write_run(tmp_path, "cart")
    rows = {(r.run, r.file): r for r in readers.read_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == 27
    assert {run for run, _ in rows} == {"deep er/cart", "a%20b", "cart"}  # folders of one name are two runs
    assert rows["deep er/cart", "original.ts"].text == samples.original()
    report = rows["a%20b", "report.json"]
    assert json.loads(report.text) == samples.summary()
    assert round(report.mtime.timestamp() * 1000) == START_MS + 98


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.ts").write_bytes(b"a\xffb\xef\xbb\xbf")
    assert readers.read_sources(spark, str(tmp_path)).first().text == "a�b﻿"


def test_read_sources_and_templates(spark, tmp_path):
    for name in ("a.ts", "b.js", "c.TS", "d.py", "e"):
        (tmp_path / name).write_text("code")
    (tmp_path / "fixer.md").write_text("Fix {{language}}:\n{{code_input}}\n{{analysis_json}}\n")
    rows = readers.read_sources(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.language) for r in rows] == [("a", "typescript"), ("b", "javascript")]
    templates = readers.read_templates(spark, str(tmp_path))
    assert [r.name for r in templates.collect()] == ["fixer"]
    doc = samples.report()
    df = spark.createDataFrame([(json.dumps(doc),)], "text string").select(
        F.lit("typescript").alias("language"), F.lit("x $1").alias("code"),
        F.try_variant_get(F.parse_json("text"), "$.analysis", readers.S.ANALYSIS).alias("analysis"),
        F.try_variant_get(F.parse_json("text"), "$.fix", readers.S.FIX).alias("fix"),
        F.try_variant_get(F.parse_json("text"), "$.tests", readers.S.TESTS).alias("tests"),
    )
    prompt = prompts.stage_prompts(df, templates, "fix").first().prompt
    # The issue list is laid out as a two-space JSON text.
    expected = json.dumps(doc["analysis"], indent=2, ensure_ascii=False)
    assert prompt == f"Fix typescript:\nx $1\n{expected}\n"
    for stage, name in prompts.TEMPLATES.items():
        one = spark.createDataFrame([(name, "{{code_input}}|{{test_count}}|{{fixes_json}}|{{fixed_code}}")], "name string, template string")
        text = prompts.stage_prompts(df, one, stage).first().prompt
        if stage == "analyze":
            assert text == "1| x $1|{{test_count}}|{{fixes_json}}|{{fixed_code}}"
        if stage == "report":
            assert text == "{{code_input}}|10|" + json.dumps(doc["fix"]["fixes"], indent=2) + "|{{fixed_code}}"


def test_read_truth(spark, tmp_path):
    (tmp_path / "cart.expected.json").write_text(json.dumps(samples.truth()))
    (tmp_path / "clean.expected.json").write_text('{"bugs": []}')
    (tmp_path / "bad.expected.json").write_text('{"bugs": [{"id": "x", "line": "1"}]}')
    truth, rejected = readers.read_truth(spark, str(tmp_path))
    assert sorted(r.run for r in truth.collect()) == ["cart", "clean"]
    assert [(r.run, r.reason, r.bad_path) for r in rejected.collect()] == [("bad", "bad_field", "bugs.0.line")]
    rows = readers.truth_bugs(truth).orderBy("pos").collect()
    assert [(r.run, r.pos, r.line) for r in rows] == [("cart", i, n) for i, n in enumerate(samples.LINES)]


def test_read_test_results(spark, tmp_path):
    samples.write_run(tmp_path, "a")
    samples.write_run(tmp_path, "b")
    (tmp_path / "b" / "vitest-fixed.json").write_text('{"numPassedTests": "1"}')
    (tmp_path / "b" / "vitest-other.json").write_text("{}")
    counts, rejected = readers.read_test_results(spark, str(tmp_path))
    assert sorted(map(tuple, counts.collect())) == [
        ("a", "fixed", 10, 0, 10), ("a", "original", 2, 8, 10), ("b", "original", 2, 8, 10),
    ]
    assert [(r.run, r.bad_path) for r in rejected.collect()] == [("b", "numPassedTests")]


def published(path):
    """Document text per run folder."""
    return {
        p.parent.name.removeprefix("run="): p.read_text() for p in path.glob("run=*/part-*") if p.stat().st_size
    }


def test_write_reports_replaces_only_its_runs(spark, tmp_path):
    docs = [samples.report() for _ in range(3)]
    docs[1]["id"], docs[2]["title"] = "other", "second edition"
    out = str(tmp_path / "out")

    def reports(*some):
        df = spark.createDataFrame([(json.dumps(d),) for d in some], "text string")
        return publish.V.validate_reports(df, "text").valid.select("report.*")

    writers.write_reports(reports(docs[0], docs[1]), out)
    writers.write_reports(reports(docs[2]), out)
    texts = published(tmp_path / "out")
    assert texts == {
        "cart": json.dumps(docs[2], indent=2, ensure_ascii=False) + "\n",
        "other": json.dumps(docs[1], indent=2, ensure_ascii=False) + "\n",
    }
    # The same in buckets; both layouts are read back as they were written.
    buckets = str(tmp_path / "buckets")
    for some in (docs[:2], docs[2:], docs[2:]):
        writers.publish_reports(reports(*some), buckets, buckets=3)
    with pytest.raises(ValueError, match="3 buckets"):
        writers.publish_reports(reports(docs[0]), buckets, buckets=5)
    for path in (out, buckets):
        valid, rejected = readers.read_published(spark, path)
        again = {r.id: json.loads(r.t) for r in valid.select("id", assembly.report_json().alias("t")).collect()}
        assert again == {"cart": docs[2], "other": docs[1]}
        assert rejected.count() == 0
    assert spark.read.parquet(buckets).count() == 2


def test_read_reports(spark, tmp_path):
    (tmp_path / "cart.json").write_text(json.dumps(samples.report(), indent=2) + "\n")
    (tmp_path / "index.json").write_text("[]")
    (tmp_path / "bad.json").write_text("{}")
    valid, rejected = readers.read_reports(spark, str(tmp_path))
    assert [r.id for r in valid.collect()] == ["cart"]
    assert [(r.path.rsplit("/")[-1], r.bad_path) for r in rejected.collect()] == [("bad.json", "schemaVersion")]


def test_index_is_versioned(spark, tmp_path):
    path = str(tmp_path / "index")
    assert readers.read_index_or_empty(spark, path).count() == 0
    ddl = readers.S.INDEX_ENTRY
    writers.write_index(spark.createDataFrame([("b", "f", "t", None, 1), ("a", "f", "t", "x", 0)], ddl), path)
    writers.write_index(readers.read_index(spark, path).union(spark.createDataFrame([("B", "f", "t", "x", 2)], ddl)), path)
    for _ in range(2):
        writers.write_index(readers.read_index(spark, path), path)
    assert {tuple(r) for r in readers.read_index(spark, path).collect()} == {
        ("b", "f", "t", None, 1), ("a", "f", "t", "x", 0), ("B", "f", "t", "x", 2),
    }
    # Old versions go, but for the one before, which may still be read.
    assert sorted(p.name for p in (tmp_path / "index/_commits").glob("0*")) == ["000000000003.json", "000000000004.json"]
    assert len(list((tmp_path / "index").glob("data-*/part=*"))) == 2
    last = json.loads((tmp_path / "index/_commits/000000000004.json").read_text())["parts"]
    lines = [x for f, *_ in last for p in sorted((tmp_path / "index" / f).glob("part-*")) for x in p.read_text().splitlines()]
    assert [json.loads(x)["id"] for x in lines] == ["a", "b", "B"]
    assert '"author":null' in lines[1]


def test_index_as_one_list(spark, tmp_path):
    """The form in which an index is published: one JSON list."""
    entries = [
        {"id": "a", "fileName": "f", "recordedAt": "t", "author": None, "issues": 2},
        {"id": "b", "fileName": "g", "recordedAt": "t", "author": "x", "issues": 0},
    ]
    (tmp_path / "index.json").write_text(json.dumps(entries, indent=2))
    for path in (tmp_path, tmp_path / "index.json"):
        assert sorted(map(tuple, readers.read_index(spark, str(path)).collect())) == [tuple(e.values()) for e in entries]
    (tmp_path / "index.json").write_text('[{"id": 1}]')
    with pytest.raises(Exception, match="index.json"):
        readers.read_index(spark, str(tmp_path)).collect()


def test_publish_runs(spark, tmp_path):
    runs, truth = tmp_path / "runs", tmp_path / "truth"
    samples.write_run(runs, "cart")
    times = {
        "analysis__json": 1000, "fixed__ts": 2500, "fixes__json": 2400, "cart__test__ts": 2500, "report__json": 4000,
    }
    stamp(runs / "cart", **times)
    far = samples.analysis()
    far["errors"] = [far["errors"][0] | {"line": None}, far["errors"][1] | {"line": 25}]
    samples.write_run(
        runs, "js-run", ".js", analysis__json=json.dumps(far),
        **{"vitest-original.json": json.dumps(samples.result(0, 0, 0))},
    )
    stamp(runs / "js-run", **{k.replace("fixed__ts", "fixed__js"): 0 for k in times})
    samples.write_run(runs, "lacking", fixes__json=None, report__json=None)
    samples.write_run(runs, "invalid", analysis__json=json.dumps(samples.analysis() | {"risk_level": "none"}))
    samples.write_run(runs, "cut", report__json='{"summary": "x"')
    samples.write_run(runs, "nometa", meta__json=None)
    samples.write_run(runs, "untested", **{"vitest-fixed.json": None})
    truth.mkdir()
    (truth / "cart.expected.json").write_text(json.dumps(samples.truth()))
    (truth / "js-run.expected.json").write_text(json.dumps(samples.truth()))
    out = tmp_path / "out"
    built = publish.publish_runs(spark, str(runs), str(out), str(truth), author="someone", model="m")

    assert {r.run: (r.reason, r.detail) for r in built.rejected.collect()} == {
        "lacking": ("missing", "fixes.json, report.json"),
        "invalid": ("bad_field", "analysis.risk_level"),
        "cut": ("bad_json", "report"),
        "nometa": ("no_run", "meta.json"),
        "untested": ("no_test_result", "fixed"),
    }
    docs = {run: json.loads(text) for run, text in published(out / "reports").items()}
    assert set(docs) == {"cart", "js-run"}
    expected = samples.report()
    expected["fix"]["fixedCode"] = samples.fixed()
    expected["source"]["recordedAt"] = "2031-04-05T06:07:12.250Z"
    expected["verification"]["command"] = "npx vitest run runs/cart/cart.test.ts"
    expected["timings"] = {
        "analyzeMs": 1000, "fixMs": 1500, "testMs": 0, "reportMs": 1500, "totalMs": 4000,
        "method": assembly.TIMING_METHOD,
    }
    assert docs["cart"] == expected
    js = docs["js-run"]
    assert js["language"] == "javascript" and "timings" not in js
    assert js["detection"] == {"expected": 6, "caught": 1, "missed": ["bug-3", "bug-8", "bug-14", "bug-19", "bug-32"]}
    assert js["verification"]["original"] == {"passed": 0, "failed": 10, "total": 10}
    index = {r.id: r for r in readers.read_index(spark, f"{out}/index").collect()}
    assert set(index) == {"cart", "js-run"} and index["js-run"].issues == 2
    # What was published is valid, and publishing again changes nothing but the index version.
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs.values()], "text string")
    assert publish.V.validate_reports(texts, "text").rejected.count() == 0
    built = publish.publish_runs(spark, str(runs), str(out), author="someone", model="m", with_timings=False)
    docs = {run: json.loads(text) for run, text in published(out / "reports").items()}
    assert "timings" not in docs["cart"] and "detection" not in docs["cart"]
    assert readers.read_index(spark, f"{out}/index").count() == 2
    assert not list(out.glob("_staging*"))
    again = readers.read_published(spark, f"{out}/reports").valid
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in built.reports.collect()) == ["cart", "js-run"]


def test_named_tests_file(spark, tmp_path):
    samples.write_run(tmp_path / "runs", "cart", **{"other.test.ts": "it('longer than the other one', () => {});\n" * 99})
    files = readers.read_runs(spark, str(tmp_path / "runs"))
    for name, cases in (("cart.test.ts", 10), ("other.test.ts", 99)):
        built = publish.build_reports(files, tests_file=name)
        assert built.reports.select(F.size("tests.cases")).first()[0] == cases
    # Without a name the last one by name counts, however long.
    assert publish.build_reports(files).reports.select(F.size("tests.cases")).first()[0] == 99
    lacking = publish.build_reports(files, tests_file="none.test.ts").rejected.first()
    assert (lacking.reason, lacking.detail) == ("missing", "none.test.ts")


def test_event_files(spark, tmp_path):
    events = [
        {"type": "stage", "stage": "analyze", "status": "running"},
        {"type": "stage", "stage": "analyze", "status": "done", "ms": 12},
        {"type": "result", "report": {"id": "x", "n": [1, None]}},
    ]
    lines = [json.dumps(e) for e in events]
    (tmp_path / "a.ndjson").write_text(lines[0] + "\n\n" + lines[1] + "\n" + lines[2] + "\n" + '{"type": "err')
    (tmp_path / "b.ndjson").write_text(lines[0] + "\nnot json\n" + lines[1] + "\n")
    rows = readers.read_event_files(spark, str(tmp_path)).orderBy("run", "seq").collect()
    assert [(r.run, r.seq, r.type, r.ms) for r in rows] == [
        ("a", 0, "stage", None), ("a", 2, "stage", 12.0), ("a", 3, "result", None),
        ("b", 0, "stage", None), ("b", 1, "error", None), ("b", 2, "stage", 12.0),
    ]
    assert json.loads(rows[2].report) == events[2]["report"] and rows[4].message == "bad_json"


def test_event_lines_round_trip(spark, tmp_path):
    rows = [("a", 1, "stage", "fix", "done", 12.5, None, None, None), ("a", 2, "result", None, None, None, None, None, '{"id":"x"}')]
    ddl = "run string, seq bigint, type string, stage string, status string, ms double, error string, message string, report string"
    events = spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_millis("seq"))
    writers.write_events(events, str(tmp_path / "log"))
    back = readers.read_event_lines(spark, str(tmp_path / "log"))
    columns = events.columns
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, events.collect()))


def test_file_times_have_milliseconds(spark, tmp_path):
    samples.write_run(tmp_path, "cart")
    stamp(tmp_path / "cart", report__json=98)
    df = readers.read_runs(spark, str(tmp_path)).filter("file = 'report.json'")
    assert df.select(T.iso_time("mtime")).first()[0] == "2031-04-05T06:07:08.348Z"
