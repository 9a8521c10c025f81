import random

import pytest
import samples
from pyspark.sql import functions as F

from reviewlake.operators import assembly, links, scoring, testruns

TRUTH = "run string, pos bigint, bug_id string, line bigint"
ISSUES = "run string, line bigint"


def brute(truth, issues, tol):
    return {
        (run, pos): any(i == run and n is not None and line is not None and abs(n - line) <= tol for i, n in issues)
        for run, pos, _, line in truth
    }


def random_tables(seed, lines=60, per_run=12):
    rng = random.Random(seed)
    truth, issues = [], []
    # One run holds a third of all rows.
    for run in ["hot"] * 8 + [f"r{i}" for i in range(16)]:
        start = sum(t[0] == run for t in truth)
        for pos in range(start, start + rng.randrange(per_run)):
            truth.append((run, pos, f"b{pos}", rng.choice([None, *range(lines)])))
        issues += [(run, rng.choice([None, *range(lines)])) for _ in range(rng.randrange(per_run))]
    return truth, issues


@pytest.mark.parametrize("tol", [0, 1, 2, 8, 9, 30])
def test_scores_equal_brute_force(spark, tol):
    truth, issues = random_tables(tol)
    t, i = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(issues, ISSUES)
    expected = brute(truth, issues, tol)
    marked = {(r.run, r.pos): r.caught for r in scoring.mark_caught(t, i, tol).collect()}
    assert marked == expected
    missed = {(r.run, r.pos) for r in scoring.missed_bugs(t, i, tol).collect()}
    assert missed == {k for k, caught in expected.items() if not caught}
    for scores in (scoring.detection_counts(t, i, tol), scoring.detection(t, i, tol)):
        rows = {r.run: r for r in scores.collect()}
        assert set(rows) == {run for run, _ in expected}
        for run, row in rows.items():
            mine = [caught for (r, _), caught in expected.items() if r == run]
            assert (row.expected, row.caught) == (len(mine), sum(mine))
    for row in scoring.detection(t, i, tol).collect():
        assert row.missed == [f"b{pos}" for (r, pos), c in sorted(expected.items()) if r == row.run and not c]
        assert row.caught + len(row.missed) == row.expected


def test_sample_run_catches_all_five(spark):
    truth = [("cart", p, b["id"], b["line"]) for p, b in enumerate(samples.truth()["bugs"])]
    issues = [("cart", e["line"]) for e in samples.analysis()["errors"]]
    row = scoring.detection(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(issues, ISSUES)).first()
    assert (row.expected, row.caught, row.missed) == (6, 6, [])


def test_one_issue_catches_two_bugs_and_distance_three_is_too_far(spark):
    truth = [("u", 0, "a", 25), ("u", 1, "b", 27), ("u", 2, "c", 29), ("v", 0, "d", 26)]
    t, i = spark.createDataFrame(truth, TRUTH), spark.createDataFrame([("u", 26)], ISSUES)
    rows = {r.run: (r.expected, r.caught, r.missed) for r in scoring.detection(t, i).collect()}
    assert rows == {"u": (3, 2, ["c"]), "v": (1, 0, ["d"])}
    runs = spark.createDataFrame([("u",), ("w",)], "run string")
    optional = {r.run: r.expected for r in scoring.with_optional(runs, scoring.detection(t, i)).collect()}
    assert optional == {"u": 3, "w": None}


def test_sparse_positions_and_any_tolerance(spark):
    """Positions may have gaps of any width, and a wide tolerance is the same rule."""
    truth = [("far", 150_000, "x", 7), ("far", 3, "y", 90), ("near", 0, "z", 10)]
    t = spark.createDataFrame(truth, TRUTH)
    i = spark.createDataFrame([("near", 30), ("far", 71)], ISSUES)
    rows = {r.run: (r.expected, r.caught, r.missed) for r in scoring.detection(t, i).collect()}
    assert rows == {"far": (2, 0, ["y", "x"]), "near": (1, 0, ["z"])}
    for tol in (2, 19, 20, 64):
        listed = {r.run: (r.expected, r.caught) for r in scoring.detection(t, i, tol).collect()}
        assert listed == {r.run: (r.expected, r.caught) for r in scoring.detection_counts(t, i, tol).collect()}
        assert listed["near"] == (1, int(tol >= 20)) and listed["far"] == (2, int(tol >= 19) + int(tol >= 64))


def test_a_run_of_many_issues_is_whole(spark):
    """150,000 issues: nested, counted and flattened without a loss."""
    n = 150_000
    pos = spark.range(n).select(F.lit("big").alias("run"), F.col("id").alias("pos"))
    issues = pos.select(
        "*", F.concat(F.lit("E"), F.col("pos") + 1).alias("issue_id"), F.lit("Logical").alias("type"),
        F.lit("d").alias("description"), F.col("pos").alias("line"), F.lit("Low").alias("severity"),
        F.lit(None).cast("string").alias("suggestion"),
    )
    none = issues.limit(0)
    fixes = none.select("run", "pos", "issue_id", F.lit("c").alias("change"))
    cases = none.select("run", "pos", F.lit("n").alias("name"), "issue_id")
    nested = assembly.nest_children(issues, fixes, cases)
    last = nested.select(F.size("errors").alias("n"), F.element_at("errors", -1)["id"].alias("id"), F.size("fixes").alias("f")).first()
    assert tuple(last) == (n, f"E{n}", 0)
    heads = spark.createDataFrame([("big", "f.ts", "2026", None), ("none", "g.ts", "2026", "me")], "run string, file_name string, recorded_at string, author string")
    entries = {r.id: r.issues for r in assembly.index_rows(heads, issues).collect()}
    assert entries == {"big": n, "none": 0}
    assert assembly.child_rows(issues, fixes, cases).count() == n


def test_severities(spark):
    df = spark.createDataFrame([("a", s) for s in samples.SEVERITY] + [("b", "Low")], "run string, severity string")
    rows = {r.run: (r.high, r.medium, r.low) for r in scoring.severity_counts(df).collect()}
    assert rows == {"a": (1, 3, 2), "b": (0, 0, 1)}


def test_missing_artifacts(spark):
    runs = spark.createDataFrame([("full", ".ts"), ("js", ".js"), ("none", ".ts")], "run string, ext string")
    files = [("full", f) for f in ("analysis.json", "fixed.ts", "fixes.json", "x.test.ts", "report.json", "meta.json")]
    files += [("js", f) for f in ("analysis.json", "fixed.ts", "fixes.json", "report.json")] + [("other", "report.json")]
    df = spark.createDataFrame(files, "run string, file string")
    rows = sorted(tuple(r) for r in links.missing_artifacts(runs, df).collect())
    assert rows == [
        ("js", "*.test.ts"), ("js", "fixed.js"), ("none", "*.test.ts"), ("none", "analysis.json"),
        ("none", "fixed.ts"), ("none", "fixes.json"), ("none", "report.json"),
    ]
    exact = links.missing_artifacts(runs, df, tests_file="y.test.ts").filter("run = 'full'").collect()
    assert [r.missing for r in exact] == ["y.test.ts"]


def test_fixed_flags_and_guards(spark):
    issues = spark.createDataFrame(
        [("a", 0, "E1", "High"), ("a", 1, "E2", "Low"), ("b", 0, "E1", "Low"), ("a", 2, "E1", "Medium")],
        "run string, pos bigint, issue_id string, severity string",
    )
    fixes = spark.createDataFrame([("a", "E1"), ("a", "E1"), ("b", "E9")], "run string, issue_id string")
    rows = sorted((r.run, r.pos, r.fixed) for r in links.issues_with_fix(issues, fixes).collect())
    assert rows == [("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, False)]
    cases = spark.createDataFrame(
        [("a", 0, "x", "E1"), ("a", 1, "y", None), ("a", 2, "z", "E7")], "run string, pos bigint, name string, issue_id string"
    )
    rows = links.cases_with_issue(cases, issues).orderBy("pos").collect()
    assert [(r.guards, r.severity, r.known) for r in rows] == [
        ("guards E1", "High", True), ("edge / happy path", None, False), ("guards E7", None, False),
    ]


def test_verification(spark):
    runs = spark.createDataFrame(
        [("a", "original", 3, 9, 12), ("a", "fixed", 12, 0, 12), ("b", "original", 0, 0, 0), ("b", "fixed", 1, 0, 3), ("c", "fixed", 0, 0, 0)],
        "run string, version string, passed bigint, failed bigint, total bigint",
    )
    cases = spark.createDataFrame([("a",)] * 12 + [("b",)] * 4, "run string")
    rows = {r.run: tuple(r)[1:] for r in testruns.verification(runs, cases).collect()}
    assert rows == {
        "a": (3, 9, 12, 12, 0, 12, False, True),
        "b": (0, 4, 4, 1, 0, 3, False, True),
        "c": (None, None, None, 0, 0, 0, None, False),
    }


def test_a_hot_run_is_split_by_the_join(spark):
    """The many-to-one joins keep working as skew joins: the hot key's partition is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    old = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        issues = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("run"),
            F.lit("E1").alias("issue_id"), F.sha2(F.col("id").cast("string"), 256).alias("note"),
        )
        fixes = spark.range(0, n, 5).select(F.col("id").alias("run"), F.lit("E1").alias("issue_id"))
        flagged = links.issues_with_fix(issues, fixes.union(spark.sql("select -1L, 'E1'")))
        counted = flagged.groupBy("run").agg(F.count_if("fixed").alias("n"))
        assert counted.filter("run = -1").first().n == n / 3
        counted.collect()
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
