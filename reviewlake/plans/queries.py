"""The registered queries: every operator over whole test tables."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions import labels, strict_json as J, text as T
from reviewlake.operators import (
    assembly,
    audit as A,
    index as I,
    links,
    scoring,
    secrets,
    testruns,
    timing,
    validation as V,
    versions,
)
from reviewlake.plans import casting as C
from reviewlake.plans import prompts
from reviewlake.session import configure, scratch, settle
from reviewlake.sources import readers, writers
from reviewlake.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*tables: str):
    """Register a function of the named tables under its own name."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(*[C.table(spark, sf_dir, t) for t in tables])

        QUERIES[build.__name__] = run
        return build

    return register


# --- scoring ------------------------------------------------------------------


@query("lineitem")
def detection(lineitem):
    return scoring.detection_counts(C.truth(lineitem), C.issue_lines(lineitem))


@query("lineitem")
def missed(lineitem):
    return scoring.missed_bugs(C.truth(lineitem), C.issue_lines(lineitem)).select("run", "bug_id", "line")


@query("orders", "lineitem")
def detection_optional(orders, lineitem):
    scored = scoring.detection_counts(C.truth(lineitem), C.issue_lines(lineitem))
    return scoring.with_optional(C.runs(orders).select("run"), scored)


@query("lineitem")
def severity_counts(lineitem):
    rows = lineitem.select(
        F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("flag")
    ).withColumn("severity", C.severity())
    return scoring.severity_counts(rows)


@query("orders", "lineitem")
def report_card(orders, lineitem):
    """All figures of a run from one aggregation of its lines, beside its detection."""
    per_run = C.line_facts(lineitem).groupBy("run").agg(
        F.count("*").alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in S.SEVERITIES],
        F.count_if("fixed").alias("fixes"),
        F.count("*").alias("cases"),
        C.total_ms(F.sum("quantity")).alias("total_ms"),
        *C.test_sums(),
    )
    counts = ["issues", *[s.lower() for s in S.SEVERITIES], "fixes", "cases"]
    figures = testruns.normalise_sides(per_run, F.col("cases"), *counts, "total_ms")
    rows = C.runs(orders).select("run").join(figures, "run", "left")
    scored = scoring.detection(C.truth(lineitem), C.issue_lines(lineitem))
    return assembly.card_of(scoring.with_optional(rows.na.fill(0, counts), scored))


# --- links --------------------------------------------------------------------


@query("lineitem")
def issues_fixed(lineitem):
    rows = lineitem.select(
        F.col("l_orderkey").alias("run"),
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("issue_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_linestatus").alias("status"),
    )
    return links.issues_with_fix(rows.drop("status"), rows.filter("status = 'F'"))


@query("part", "lineitem")
def case_guards(part, lineitem):
    name = F.when(
        F.col("p_size") % 2 == 0,
        F.concat(F.lit("[E"), (F.col("p_size") % 7 + 1).cast("string"), F.lit("] "), "p_name"),
    ).otherwise(F.col("p_name"))
    cases = part.select(
        F.col("p_partkey").alias("run"), F.lit(0).cast("bigint").alias("pos"), name.alias("name")
    ).withColumn("issue_id", T.issue_tag("name"))
    issues = lineitem.select(
        F.col("l_partkey").alias("run"),
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("issue_id"),
        F.struct("l_orderkey", "l_suppkey", "l_quantity", F.col("l_returnflag")).alias("pos"),
        F.col("l_returnflag").alias("flag"),
    ).withColumn("severity", C.severity())
    return links.cases_with_issue(cases, issues).drop("pos")


@query("lineitem")
def verification(lineitem):
    cases = lineitem.select(F.col("l_orderkey").alias("run"))
    return testruns.verification(C.test_runs(lineitem), cases)


@query("orders", "lineitem")
def missing_artifacts(orders, lineitem):
    return links.missing_artifacts(C.runs(orders), C.run_files(lineitem))


@query("orders")
def upsert_index(orders):
    entries = orders.select(
        F.col("o_custkey").cast("string").alias("id"),
        F.concat(F.lit("src/order"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("file_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("author"),
        "o_orderkey",
        "o_orderdate",
    )
    change = F.lit("1999-01-01").cast("timestamp_ntz")
    old = entries.filter(F.col("o_orderdate") < change).drop("o_orderdate")
    new = entries.filter(F.col("o_orderdate") >= change).drop("o_orderdate")
    latest = I.upsert_index(old, new, "recorded_at", "o_orderkey")
    return I.sort_index(latest.drop("o_orderkey"))


@query("orders", "lineitem")
def assemble(orders, lineitem):
    r = _reports(orders, lineitem)
    errors = F.col("analysis.errors")
    return r.select(
        F.col("id").alias("run"),
        "fileName",
        F.col("source.author").alias("author"),
        F.col("analysis.risk_level").alias("risk"),
        F.array_join(
            F.transform(errors, lambda e: F.concat(e["id"], F.lit(":"), e["severity"], F.lit(":"), e["description"])), "|"
        ).alias("issues"),
        F.array_join(F.transform("fix.fixes", lambda f: f["issueId"]), "|").alias("fixes"),
        F.array_join(F.transform("tests.cases", lambda c: c["name"]), "|").alias("cases"),
        F.col("verification.fixed.passed").alias("fixed_passed"),
        F.col("detection.expected").alias("expected"),
        F.col("detection.caught").alias("caught"),
        F.array_join("detection.missed", "|").alias("missed"),
    )


def _reports(orders, lineitem):
    """Documents from one aggregation of a run's lines, beside its detection."""
    orders, lineitem = C.dealt(orders, *C.HEAD_COLUMNS), C.dealt(lineitem, *C.LINE_COLUMNS)
    children = C.line_facts(lineitem).groupBy("run").agg(
        *assembly.child_lists(fixes=F.col("fixed")), F.count("*").alias("n_cases"), *C.test_sums()
    )
    children = testruns.normalise_sides(children, F.col("n_cases"), "errors", "fixes", "cases")
    return assembly.assemble_reports(
        C.heads(orders),
        children,
        verification=True,
        detection=scoring.detection(C.truth(lineitem), C.issue_lines(lineitem)),
        command=F.concat(F.lit("npx vitest run runs/"), F.col("run").cast("string"), F.lit("/x.test.ts")),
    )


@query("orders", "lineitem")
def flatten_report(orders, lineitem):
    """Reports to JSON text, strictly validated, and flattened back to issues."""
    texts = _reports(orders, lineitem).select(assembly.report_json().alias("text"))
    valid = V.validate_reports(texts, "text").valid.select("report.*")
    return assembly.flatten_issues(valid)


@query("orders", "lineitem")
def flatten_fixes(orders, lineitem):
    return assembly.flatten_fixes(_reports(orders, lineitem))


@query("orders", "lineitem")
def flatten_cases(orders, lineitem):
    return assembly.flatten_cases(_reports(orders, lineitem))


@query("orders", "lineitem")
def flatten_test_runs(orders, lineitem):
    return assembly.flatten_test_runs(_reports(orders, lineitem))


_HEADLINE = "{{ISSUES}} found, {{FIXED}} fixed, {{ORIG_PASS}} to {{FIXED_PASS}} of {{TESTS}}, {{CAUGHT}}/{{EXPECTED}}"


@query("orders", "lineitem")
def headline(orders, lineitem):
    filled = T.fill_placeholders(F.lit(_HEADLINE), assembly.headline_values())
    return _reports(orders, lineitem).select(F.col("id").alias("run"), filled.alias("headline"))


def _good_reports(orders):
    """A report document per order: run, good."""
    none = orders.sparkSession.createDataFrame([], "run bigint, expected bigint, caught bigint, missed array<string>")
    heads = C.heads(C.dealt(orders, *C.HEAD_COLUMNS)).withColumns({"model": F.lit("m")})
    two = F.transform(
        F.array(F.lit(1), F.lit(2)),
        lambda n: F.struct(
            F.concat(F.lit("E"), n.cast("string")).alias("id"), F.lit("Logical").alias("type"), F.lit("d").alias("description"),
            n.cast("bigint").alias("line"), F.lit("Low").alias("severity"), F.lit(None).cast("string").alias("suggestion"),
        ),
    )
    empty = [F.array().cast(f"array<{kind}>") for kind in (S.FIX_ITEM, S.CASE)]
    children = heads.select("run", two.alias("errors"), empty[0].alias("fixes"), empty[1].alias("cases"))
    return assembly.assemble_reports(heads, children, detection=none).select(
        F.col("id").alias("run"), assembly.report_json().alias("good")
    )


# Ways to break a report in one place.
_SWAPS = {
    1: ('"schemaVersion":1', '"schemaVersion":2'),
    2: ('"title":"', '"heading":"'),
    3: ('"language":"typescript"', '"language":"python"'),
    4: (f'"kind":"{S.RECORDED}"', '"kind":"other"'),
    5: ('"recordedAt":"', '"recordedAt":null,"was":"'),
    6: ('"model":"m"', '"model":null'),
    7: ('"originalCode":"', '"originalCode":7,"was":"'),
    8: ('"risk_level":"', '"risk_level":"Very '),
    9: ('"line":2', '"line":2.5'),
    10: ('"cases":[]', '"cases":{}'),
    11: ('"recommendations":["check it",', '"recommendations":["check it",4,'),
    12: ('"title":"', '"title":3,"title":"'),  # of a repeated key the last value counts
    13: ('"schemaVersion":1,', '"schemaVersion":1,,'),
    15: ('"schemaVersion":1,', '"schemaVersion":1.0,"unknown":[{}],'),
}


@query("orders")
def validate_reports(orders):
    """Report documents, most of them broken in one place by their order key."""
    texts, k = _good_reports(orders), F.col("run").cast("bigint") % 16
    text = F.col("good")
    for number, (old, new) in _SWAPS.items():
        text = F.when(k == number, F.replace("good", F.lit(old), F.lit(new))).otherwise(text)
    text = F.when(k == 14, F.concat("good", F.lit(" trailing"))).otherwise(text)
    checked = V.check_json(texts.select("run", text.alias("text")), "text", V.REPORT, S.REPORT, "report")
    return checked.select("run", "reason", "bad_path")


@query("orders")
def bad_fields(orders):
    """All bad fields of report documents, most of them broken in two places."""
    run = F.col("run").cast("bigint")
    first, second = run % 12, F.floor(run / 12) % 12
    text = F.col("good")
    for number, (old, new) in _SWAPS.items():
        if number < 12:
            # The text stands in each step once: twice, and its expression would double with each.
            text = F.replace(text, F.lit(old), F.when((first == number) | (second == number), F.lit(new)).otherwise(F.lit(old)))
    return V.bad_fields(_good_reports(orders).select("run", text.alias("text")), "text")


@query("orders")
def test_results(orders):
    return readers.test_results(C.result_files(orders)).valid


@query("orders")
def rejected_results(orders):
    return readers.test_results(C.result_files(orders)).rejected.select("run", "version", "reason", "bad_path")


@query("orders")
def truth_bugs(orders):
    return readers.truth_bugs(C.truth_lists(orders))


@query("events")
def parse_events(events):
    return readers.parse_events(C.event_texts(events), "line", "event_id")


@query("events")
def logged_events(events):
    """Events as they are read back from a log written in two batches, the first of which came twice."""
    path = f"{scratch(events.sparkSession)}/log"
    rows = C.run_events(events).withColumn("seq", F.col("seq.event_id"))
    for batch in (0, 1, 0):
        writers.write_events(rows.filter(F.col("seq") % 2 == batch), path, batch=batch)
    return readers.read_event_lines(events.sparkSession, path).select("run", "seq", "type", "stage", "status", "ms", "message", "report")


@query("events")
def event_lines(events):
    rows = C.run_events(events).withColumn("seq", F.col("seq.event_id"))
    return writers.event_lines(rows)


@query("events")
def iso_times(events):
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("at "), T.iso_time(ts))).otherwise(T.iso_time(ts))
    return events.select("event_id", T.iso_time(ts).alias("iso"), F.unix_millis(T.parse_iso(text)).alias("ms"))


@query("orders", "lineitem")
def index_entries(orders, lineitem):
    """What the index holds about every run; its issues are counted, no document is built."""
    return _index_rows(orders, lineitem)


def _index_rows(orders, lineitem):
    return assembly.index_rows(C.heads(C.dealt(orders, *C.HEAD_COLUMNS)), C.issues(C.dealt(lineitem, *C.LINE_COLUMNS)))


@query("orders", "lineitem")
def published_index(orders, lineitem):
    """The index as it is read after two publishes, the second of which came twice: of all runs, then of those with issues."""
    path = scratch(orders.sparkSession)
    entries = settle(_index_rows(orders, lineitem), f"{path}/entries")
    writers.publish_index(entries.withColumn("issues", F.lit(0).cast("bigint")), f"{path}/index", "recordedAt", per_range=20_000)
    for _ in range(2):
        raised = entries.filter("issues > 0")
        writers.publish_index(raised, f"{path}/index", "recordedAt", per_range=20_000, writer="queries", batch=0)
    return readers.read_index(orders.sparkSession, f"{path}/index")


# --- text ---------------------------------------------------------------------


@query("documents")
def to_lines(documents):
    return T.to_lines(documents, "text", keep=["doc_id"])


@query("documents")
def number_lines(documents):
    return documents.select("doc_id", T.number_lines("text").alias("numbered"))


_TEMPLATE = "Part {{name}} of {{brand}}: {{type}}, {{name}} {{unknown}} {{ name }}\nend"


def _part_values():
    return F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")
    )


@query("part")
def render_template(part):
    return part.select(
        "p_partkey", T.render_template(F.lit(_TEMPLATE), _part_values()).alias("prompt")
    )


@query("part")
def fill_placeholders(part):
    return part.select(
        "p_partkey", T.fill_placeholders(F.lit(_TEMPLATE), _part_values()).alias("slide")
    )


@query("documents")
def analyze_prompts(documents):
    """Documents as requests: checked, line-numbered and put into the stage's template."""
    requests = documents.select(
        "doc_id", F.col("text").alias("code"), F.lit(None).cast("string").alias("language"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("file_name"),
    )
    templates = documents.sparkSession.createDataFrame(
        [("analyzer", "Review this {{language}} code.\n\n{{code_input}}\n\nReturn {{shape}}\n")],
        "name string, template string",
    )
    valid = V.validate_requests(requests).valid
    return prompts.stage_prompts(valid, templates, "analyze").select("doc_id", "file_name", "prompt")


@query("events")
def extract_json(events):
    texts = events.select("event_id", F.concat(F.lit("note "), "props", F.lit(" end")).alias("text"))
    return V.extract_json(texts, "text").select(
        "event_id", F.try_variant_get("value", "$.k", "bigint").alias("k"), "reason"
    )


@query("pages")
def extract_json_bad(pages):
    found = V.extract_json(pages.select("page_id", "html"), "html")
    return found.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("pages")
    )


def _test_file(name):
    return F.concat(
        F.lit("describe('x', () => {\n  it('[E"), F.col("p_size").cast("string"), F.lit("] "), name,
        F.lit("', () => {});\n  it.only('skipped', f);\n  xit('not run', f);\n  it(\n    \""), name,
        F.lit(" it's \", f);\n  it(`[X1] "), name, F.lit(" [E7][E8]`, f);\n});\n"),
    )


@query("part")
def extract_cases(part):
    files = part.select("p_partkey", _test_file(F.col("p_name")).alias("code"))
    return T.extract_cases(files, "code", "p_partkey")


def _document_path():
    ext = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".js", ".TS", ".d.ts")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat(F.lit("src\\"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), ext)


@query("documents")
def file_meta(documents):
    meta = T.file_meta(documents.select("doc_id", _document_path().alias("path")), "path")
    return V.supported_files(meta).drop("path")


@query("orders")
def run_id_filter(orders):
    key = F.col("o_orderkey").cast("string")
    mark = F.when(F.col("o_orderstatus") == "F", "#").when(F.col("o_orderstatus") == "P", "_").otherwise("-")
    return V.valid_run_ids(orders.select(F.concat(F.lit("run"), mark, key).alias("run")))


@query("lineitem")
def fmt_duration(lineitem):
    ms = F.col("l_orderkey") * 37 % 200_000 + F.col("l_linenumber") * 50
    return lineitem.select("l_orderkey", "l_linenumber", ms.alias("ms")).select(
        "l_orderkey", "l_linenumber", labels.fmt_secs("ms").alias("secs"), labels.fmt_time("ms").alias("time")
    )


# --- validation ---------------------------------------------------------------


@query("documents")
def validate_requests(documents):
    d = F.col("doc_id")
    code = F.when(d % 50 == 0, F.lit(" \t\n ")).otherwise(F.concat(F.lit(" \n"), "text", F.lit("\t \n")))
    requests = documents.select(
        "doc_id",
        code.alias("code"),
        F.when(d % 7 == 1, F.lit("python")).when(d % 7 == 2, "javascript").alias("language"),
        F.when(d % 11 == 1, F.repeat(F.lit("f"), (d % 240).cast("int"))).alias("file_name"),
    )
    checked = V.check_requests(requests)
    return checked.select(
        "doc_id", "language", "file_name", "reason", F.md5("code").alias("code_md5"),
        F.length("code").cast("bigint").alias("n"),
    )


@query("events")
def validate_records(events):
    kind = F.col("event_id") % 8
    k = F.get_json_object("props", "$.k")
    record = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"k": '), k, F.lit(".5}")))
        .when(kind == 3, F.lit('{"k": null}'))
        .when(kind == 4, F.lit('{"j": 1}'))
        .when(kind == 5, F.concat(F.lit('{"x": [1], "k": '), k, F.lit(".0}")))
        .when(kind == 6, F.concat("props", F.lit(" trailing")))
        .otherwise(F.concat("props", F.lit("],["), "props"))
    )
    records = events.select("event_id", record.alias("record"))
    checked = V.check_json(records, "record", J.fields(k=J.nullable(J.integer())), "struct<k: bigint>")
    return checked.select("event_id", "reason", "bad_path", F.col("value.k").alias("k"))


@query("events")
def flatten_props(events):
    checked = V.check_json(
        events.select("event_id", "props"), "props", J.fields(k=J.integer()), "struct<k: bigint>"
    )
    return V.split_checked(checked).valid.select("event_id", "value.k")


@query("documents")
def scan_secrets(documents):
    path = F.concat(F.lit("src/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".ts"))
    files = documents.select("doc_id", path.alias("path"), "text")
    return secrets.scan_secrets(files).select("doc_id", "path", "line_no")


# --- time and events ------------------------------------------------------------


@query("events")
def stage_timings(events):
    return timing.stage_timings(C.stamps(events))


@query("events")
def first_valid_attempt(events):
    shape = J.fields(k=J.integer())
    checked = V.check_response(C.responses(events), "text", shape, "struct<k: bigint>")
    attempts = checked.select(
        "run", "stage", "attempt", "started", "ended",
        F.col("value.k").alias("result"), F.col("reason").alias("error"),
    )
    return timing.first_valid_attempt(attempts)


@query("events")
def stage_state(events):
    return progress.stage_state(C.progress_events(events))


@query("events")
def stage_elapsed(events):
    return progress.stage_elapsed(C.progress_events(events))


@query("events")
def stage_progress(events):
    return progress.stage_progress(C.progress_events(events))


@query("events")
def run_outcome(events):
    return progress.run_outcome(C.run_events(events))


@query("events")
def seen_state(events):
    """Stage states as a reader sees them, who stops at a run's first error."""
    return progress.stage_state(progress.until_first_error(C.run_events(events)))


# --- versions -----------------------------------------------------------------


@query("documents")
def line_delta(documents):
    return versions.line_delta(C.version_pairs(documents), "base_id", "doc_id")


@query("documents")
def side_by_side(documents):
    return versions.side_by_side(C.version_pairs(documents), "base_id", "doc_id")


@query("documents")
def diff_stats(documents):
    return versions.change_share(versions.pair_stats(C.version_pairs(documents), "source", "doc_id"), "source")


# --- contracts ------------------------------------------------------------------


_TESTS = [f"{v}_{c}" for v in S.VERSIONS for c in ("rows", "failed", "total")]


@query("orders", "lineitem", "part")
def contract_audit(orders, lineitem, part):
    # One task must not hold the groups of a whole table.
    orders, lineitem = C.dealt(orders, *C.HEAD_COLUMNS), C.dealt(lineitem, *C.LINE_COLUMNS)
    part = C.dealt(part, "p_partkey", "p_name", "p_size")
    code = F.array_join(F.array_repeat("o_orderpriority", (F.col("o_orderkey") % 7 + 1).cast("int")), "\n")
    originals = orders.select(F.col("o_orderkey").alias("run"), F.size(T.split_lines(code)).alias("lines"))
    rows = C.line_facts(lineitem).join(originals, "run", "left")
    shifted = F.col("pos") + F.when(F.col("part") % 11 == 0, 1).otherwise(0)
    tag = F.when(F.col("pos") == 3, F.lit("E9")).otherwise(F.col("case_issue_id"))
    stated = rows.select(
        F.inline(F.array(
            A.fact(
                "run", A.issue_key("issue_id"), issue=F.lit(1), urgent=A.is_urgent("severity"), case=F.col("case_issue_id").isNotNull(),
                ids_in_order=F.col("issue_id") != F.concat(F.lit("E"), (shifted + 1).cast("string")),
                line_exists=A.line_is_off("line", "lines"),
            ),
            A.fact(
                "run", A.title_key("name"), title=F.when(F.col("pos") == 5, 1).otherwise(0),
                tag_is_issue=~T.issue_tag("name").eqNullSafe(tag),
            ),
        )),
        *_TESTS,
    )
    fix = F.concat(F.lit("E"), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("string"))
    fixes = lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run"), fix.alias("issue_id"))
    analyses = orders.select(F.col("o_orderkey").alias("run"), C.risk().alias("risk_level"))
    advice = part.select(
        F.col("p_partkey").alias("run"),
        F.array_repeat(
            F.array_join(F.array_repeat("p_name", F.col("p_size") % 14 + 1), " "), F.col("p_size") % 6
        ).alias("recommendations"),
    )
    others = [
        A.facts(fixes, A.fact("run", A.issue_key("issue_id"), fix=F.lit(1))),
        A.facts(analyses, A.fact("run", raised=F.col("risk_level") != "Low")),
        A.facts(advice, A.advice_fact("run", "recommendations")),
    ]
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, stated)
    # An issue is stated twice, as itself and by its title; its tests count once.
    once = {c: F.when(F.col("issue") == 1, F.col(c)) for c in _TESTS}
    # A crashed run counts all its cases as failed.
    failed = {
        v: F.when(F.col(f"{v}_rows") > 0, F.when(F.col(f"{v}_total") == 0, F.col("issue")).otherwise(F.col(f"{v}_failed"))) for v in S.VERSIONS
    }
    proven = (failed["fixed"] == 0) & (failed["original"] > 0)
    has_tests = F.coalesce(sum(F.col(f"{v}_rows") for v in S.VERSIONS) > 0, F.lit(False))
    return A.audit_facts(facts, once, tests_prove_fix=has_tests & ~F.coalesce(proven, F.lit(False)))
