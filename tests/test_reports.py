import json

import samples
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions import text as T
from reviewlake.functions.json_text import json_of
from reviewlake.operators import assembly, audit, index, timing
from reviewlake.operators import validation as V

ENTRY = "id string, fileName string, recordedAt string, author string, issues bigint"


def read(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "text string")
    return V.validate_reports(df, "text").valid.select("report.*")


def test_json_text_is_the_document_again(spark):
    full = samples.report()
    bare = samples.report()
    del bare["verification"], bare["detection"], bare["source"]["author"], bare["source"]["model"]
    bare["id"] = "bare"
    bare["analysis"]["errors"] = [samples.issue(0)]
    bare["analysis"]["errors"][0]["line"] = None
    del bare["analysis"]["errors"][0]["suggestion"]
    bare["fix"]["fixes"] = []
    bare["timings"] = {"analyzeMs": 1.5, "fixMs": 0, "testMs": 2, "reportMs": 3, "totalMs": 98, "method": "m"}
    reports = read(spark, full, bare)
    for indent in (None, 0):
        texts = {r.id: r.text for r in reports.select("id", assembly.report_json(indent).alias("text")).collect()}
        for doc in (full, bare):
            layout = {"separators": (",", ":")} if indent is None else {"indent": 2}
            assert json.loads(texts[doc["id"]]) == doc
            assert texts[doc["id"]] == json.dumps(doc, ensure_ascii=False, **layout)


def test_assembled_from_flat_tables(spark):
    source = read(spark, samples.report())
    heads = source.select(
        F.col("id").alias("run"), "title", F.col("fileName").alias("file_name"), "language", "source.kind",
        "source.model", F.col("source.recordedAt").alias("recorded_at"), "source.author",
        F.col("originalCode").alias("original_code"), F.col("fix.fixedCode").alias("fixed_code"),
        "analysis.risk_level", F.col("analysis.summary").alias("analysis_summary"), "tests.framework",
        F.col("tests.code").alias("test_code"), F.col("report.summary").alias("report_summary"),
        "report.recommendations",
    )
    empty = heads.withColumn("run", F.lit("empty"))
    children = assembly.nest_children(
        assembly.flatten_issues(source).orderBy(F.rand(1)), assembly.flatten_fixes(source), assembly.flatten_cases(source)
    )
    sides = source.select(
        F.col("id").alias("run"),
        *[F.col(f"verification.{v}.{c}").alias(f"{v}_{c}") for v in S.VERSIONS for c in ("passed", "failed", "total")],
    )
    scored = source.select(F.col("id").alias("run"), "detection.*")
    built = assembly.assemble_reports(
        heads.unionByName(empty), children, verification=sides, detection=scored, command=F.lit("npx vitest run")
    )
    docs = {r.id: json.loads(r.t) for r in built.select("id", assembly.report_json().alias("t")).collect()}
    assert docs["cart"] == samples.report()
    assert docs["empty"]["analysis"]["errors"] == [] and "detection" not in docs["empty"]
    assert "verification" not in docs["empty"] and docs["empty"]["tests"]["cases"] == []
    assert V.validate_reports(built.select(assembly.report_json().alias("t")), "t").rejected.count() == 0
    tables = [f(source) for f in (assembly.flatten_issues, assembly.flatten_fixes, assembly.flatten_cases)]
    rows = assembly.child_rows(*tables).collect()
    items = {(r.kind, r.pos): json.loads(r.item) for r in rows}
    assert len(items) == len(rows) == 22
    assert [items["errors", i] for i in range(6)] == samples.analysis()["errors"]
    assert items["cases", 8] == {"name": "edge 8", "issueId": None}


def test_flat_tables_and_card(spark):
    reports = read(spark, samples.report())
    issues = assembly.flatten_issues(reports).orderBy("pos").collect()
    assert [(r.pos, r.issue_id, r.line) for r in issues] == [(i, f"E{i + 1}", n) for i, n in enumerate(samples.LINES)]
    assert [r.issue_id for r in assembly.flatten_cases(reports).orderBy("pos").collect()] == samples.TAGS
    assert assembly.flatten_fixes(reports).count() == 6
    runs = assembly.flatten_test_runs(reports).orderBy("version").collect()
    assert [tuple(r) for r in runs] == [("cart", "fixed", 10, 0, 10), ("cart", "original", 2, 8, 10)]
    card = assembly.report_card(reports).first()
    assert tuple(card) == (
        "cart", 6, "1 high · 3 medium · 2 low", 6, 10, "6/6", "none missed", "2 → 10", 10, None,
    )
    entry = assembly.index_entries(reports).first()
    assert tuple(entry) == ("cart", "samples/cart.ts", "2031-04-05T06:07:08.348Z", "someone", 6)


def test_headline_values(spark):
    bare = samples.report()
    bare["id"] = "bare"
    del bare["verification"], bare["detection"]
    timed = samples.report()
    timed["id"] = "timed"
    timed["timings"] = dict.fromkeys(("analyzeMs", "fixMs", "testMs", "reportMs"), 1) | {"totalMs": 90_000, "method": "m"}
    slide = F.lit("{{ISSUES}} {{FIXED}} {{TESTS}} {{ORIG_PASS}} {{FIXED_PASS}} {{CAUGHT}}/{{EXPECTED}} {{TIME}} {{URL}}")
    rows = read(spark, samples.report(), bare, timed).select(
        "id", T.fill_placeholders(slide, assembly.headline_values()).alias("text")
    )
    assert {r.id: r.text for r in rows.collect()} == {
        "cart": "6 6 10 2 10 6/6 1 task –", "bare": "6 6 – – – –/– 1 task –", "timed": "6 6 10 2 10 6/6 1.5 min –",
    }


def test_index_upsert(spark):
    old = spark.createDataFrame([(i, "f", "2026-01-01", "x", 1) for i in ("b", "a", "B", "ab")], ENTRY)
    new = spark.createDataFrame(
        [("a", "g", "2026-01-02", None, 2), ("a", "h", "2026-01-03", None, 3), ("a-b", "g", "2025", "y", 0)], ENTRY
    )
    once = index.upsert_index(old, new, "recordedAt")
    assert [r.id for r in index.sort_index(once).collect()] == ["a", "a-b", "ab", "b", "B"]
    # The whole entry is replaced, its null author too.
    assert tuple(once.filter("id = 'a'").first()) == ("a", "h", "2026-01-03", None, 3)
    twice = index.upsert_index(once, new, "recordedAt")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_stage_timings(spark):
    t = "2026-09-27 14:19:0"
    runs = {
        "ok": ["1.0005", "2", "3", "2.5", "3", "4.1"],
        "equal start": ["1", "1", "2", "2", "3", "4"],
        "fix early": ["1", "2", "1.5", "1.5", "3", "4"],
        "report early": ["1", "2", "3", "3", "4", "3.999"],
    }
    rows = [(run, name, t + at) for run, ends in runs.items() for name, at in zip(timing.STAMPED, ends)]
    rows += [("no fixes", n, t + at) for n, at in zip(timing.STAMPED, runs["ok"]) if n != "fixes"]
    df = spark.createDataFrame(rows, "run string, artifact string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.run: tuple(r)[1:] for r in timing.stage_timings(df).collect()}
    assert got.pop("ok") == (1000, 1000, 0, 1100, 3100)
    assert set(got.values()) == {(None,) * 5} and len(got) == 4
    live = spark.createDataFrame([(1, 2, None)], "a bigint, b bigint, c bigint")
    assert live.select(timing.live_total("a", "b", "c")).first()[0] == 3


def test_first_valid_attempt(spark):
    rows = [
        ("a", "fix", 1, None, "bad_json", 0, 1000), ("a", "fix", 2, "ok", None, 1000, 5500),
        ("b", "fix", 1, "one", None, 0, 3000), ("b", "fix", 2, "two", None, 3000, 9000),
        ("c", "fix", 1, None, "no_object", 0, 1000), ("c", "fix", 2, None, "bad_field", 1000, 2000), ("c", "fix", 3, "late", None, 2000, 3000),
    ]
    df = spark.createDataFrame(rows, "run string, stage string, attempt int, result string, error string, started bigint, ended bigint")
    got = sorted(tuple(r) for r in timing.first_valid_attempt(df).collect())
    assert got == [
        ("a", "fix", 2, "ok", None, 6), ("b", "fix", 1, "one", None, 3), ("c", "fix", None, None, "bad_field", 2),
    ]


def test_contract_audit(spark):
    def table(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    issues = table(
        [("a", 0, "E1", 1, "High"), ("a", 1, "E3", 9, "Medium"), ("a", 2, "E4", None, "Low"), ("a", 3, "E4", 0, "Low")],
        "run string, pos bigint, issue_id string, line bigint, severity string",
    )
    originals = table([("a", "x\ny\n"), ("b", "")], "run string, code string")
    analyses = table([("a", "High"), ("b", "Medium"), ("c", "Low")], "run string, risk_level string")
    fixes = table([("a", "E1"), ("a", "E1"), ("a", "E9"), ("a", "E4")], "run string, issue_id string")
    cases = table(
        [("a", "[E1] x", "E1"), ("a", "plain", None), ("a", "[E3] y", None), ("a", "[E4] [E5] z", "E5"), ("a", "w", "E1")],
        "run string, name string, issue_id string",
    )
    found = table([("a", "[E1] x"), ("a", "plain"), ("a", "plain"), ("a", "[E3] y"), ("a", "w"), ("a", "new")], "run string, name string")
    sides = table([("a", 3, 0), ("b", 0, 0), ("c", 3, 1)], "run string, original_failed bigint, fixed_failed bigint")
    advice = table(
        [("sample", samples.summary()["recommendations"]), ("one", [" a  b "]), ("five", ["x"] * 5)],
        "run string, recommendations array<string>",
    )
    facts = audit.all_facts(issues, originals, analyses, fixes, cases, found, sides, advice)
    one_pass = {(r.rule, r.run): r.violations for r in audit.audit_facts(facts).collect()}
    rows = audit.contract_audit(
        audit.issue_order(issues), audit.issue_lines(issues, originals), audit.clean_is_low(analyses, issues),
        audit.issue_links(issues, fixes, cases), audit.tests_prove_fix(sides), audit.declared_cases(cases, found),
        audit.recommendation_style(advice), audit.case_tags(cases),
    ).collect()
    assert {(r.rule, r.run): r.violations for r in rows} == one_pass == {
        ("ids_in_order", "a"): 2,
        ("line_exists", "a"): 2,
        ("clean_is_low", "b"): 1,
        ("urgent_is_fixed", "a"): 1,
        ("one_fix_per_issue", "a"): 1,
        ("fix_of_known_issue", "a"): 1,
        ("fixed_is_tested", "a"): 1,
        ("tests_prove_fix", "b"): 1,
        ("tests_prove_fix", "c"): 1,
        ("cases_match_tests", "a"): 3,
        ("recommendation_length", "sample"): 3,
        ("recommendation_count", "one"): 1,
        ("recommendation_count", "five"): 1,
        ("tag_is_issue", "a"): 3,
    }


def test_typed_json_of_nested_values(spark):
    df = spark.createDataFrame([([],), (None,)], "x array<struct<issueId: string, change: string>>")
    texts = [r[0] for r in df.select(json_of("x", f"array<{S.FIX_ITEM}>", 0)).collect()]
    assert texts == ["[]", "null"]
