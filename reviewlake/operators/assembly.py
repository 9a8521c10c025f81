"""Build, publish, flatten and summarise report documents."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake import schemas as S
from reviewlake.functions.json_text import json_of
from reviewlake.functions.labels import (
    before_after_label,
    caught_label,
    fmt_secs,
    fmt_time,
    missed_label,
    or_dash,
    severity_label,
)
from reviewlake.operators.nesting import ordered_list

TIMING_METHOD = "measured from the time each stage wrote its output file"

ISSUE_FIELDS = {
    "id": "issue_id",
    "type": "type",
    "description": "description",
    "line": "line",
    "severity": "severity",
    "suggestion": "suggestion",
}
FIX_FIELDS = {"issueId": "issue_id", "change": "change"}
CASE_FIELDS = {"name": "name", "issueId": "issue_id"}


def _item(fields: dict[str, str], ddl: str) -> Column:
    return F.struct(*[F.col(c).alias(name) for name, c in fields.items()]).cast(ddl)


def nest_children(issues: DataFrame, fixes: DataFrame, cases: DataFrame) -> DataFrame:
    """Per run the ordered lists ``errors``, ``fixes`` and ``cases``.

    The three child tables go through a single aggregation.  Positions are
    unique per run and kind, and may have gaps.
    """
    kinds = {
        "errors": (issues, _item(ISSUE_FIELDS, S.ISSUE), S.ISSUE),
        "fixes": (fixes, _item(FIX_FIELDS, S.FIX_ITEM), S.FIX_ITEM),
        "cases": (cases, _item(CASE_FIELDS, S.CASE), S.CASE),
    }
    tagged = None
    for kind, (rows, item, _) in kinds.items():
        part = rows.select(
            "run",
            F.lit(kind).alias("kind"),
            F.col("pos").cast("bigint").alias("pos"),
            *[
                (item if k == kind else F.lit(None).cast(ddl)).alias(f"_{k}")
                for k, (_, _, ddl) in kinds.items()
            ],
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    lists = [ordered_list(F.col(f"_{kind}"), "pos", F.col("kind") == kind).alias(kind) for kind in kinds]
    return tagged.groupBy("run").agg(*lists)


def child_lists(**kept: Column | None) -> list[Column]:
    """The same lists as aggregates over one table that holds the columns of all three kinds.

    ``kept`` has a condition by kind where not every row is of it.  Columns: those of ``ISSUE_FIELDS`` and
    ``FIX_FIELDS``, and ``name`` with ``case_issue_id`` for the cases.
    """
    items = {
        "errors": _item(ISSUE_FIELDS, S.ISSUE),
        "fixes": _item(FIX_FIELDS, S.FIX_ITEM),
        "cases": _item(CASE_FIELDS | {"issueId": "case_issue_id"}, S.CASE),
    }
    return [ordered_list(item, "pos", kept.get(kind)).alias(kind) for kind, item in items.items()]


def child_rows(issues: DataFrame, fixes: DataFrame, cases: DataFrame) -> DataFrame:
    """All children of all runs as rows (run, kind, pos, item); ``item`` is JSON text.

    The row form of what ``nest_children`` puts into documents, for readers that take no document whole.
    """
    kinds = {
        "errors": (issues, ISSUE_FIELDS, S.ISSUE),
        "fixes": (fixes, FIX_FIELDS, S.FIX_ITEM),
        "cases": (cases, CASE_FIELDS, S.CASE),
    }
    parts = [
        rows.select("run", F.lit(kind).alias("kind"), F.col("pos").cast("bigint").alias("pos"), _item(names, ddl).alias("item"))
        .withColumn("item", json_of("item", ddl))
        for kind, (rows, names, ddl) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def verification_struct(command: Column) -> Column:
    """Absent unless both versions have a result."""
    sides = [
        F.struct(*[F.col(f"{v}_{c}").alias(c) for c in ("passed", "failed", "total")]).alias(v)
        for v in S.VERSIONS
    ]
    both = F.col("original_total").isNotNull() & F.col("fixed_total").isNotNull()
    return F.when(both, F.struct(command.alias("command"), *sides))


def detection_struct() -> Column:
    """Absent without ground truth."""
    return F.when(F.col("expected").isNotNull(), F.struct("expected", "caught", "missed"))


def timings_struct(method: str = TIMING_METHOD) -> Column:
    spans = [
        F.col(f"{name}_ms").cast("double").alias(f"{name}Ms")
        for name in ("analyze", "fix", "test", "report", "total")
    ]
    return F.when(F.col("total_ms").isNotNull(), F.struct(*spans, F.lit(method).alias("method")))


def assemble_reports(
    heads: DataFrame,
    children: DataFrame,
    verification: DataFrame | bool | None = None,
    detection: DataFrame | None = None,
    timings: DataFrame | None = None,
    command: Column | None = None,
) -> DataFrame:
    """One report document per head row, in the column layout of ``schemas.REPORT``.

    Every input has one row per run.  ``children`` comes from ``nest_children``;
    a run without children gets empty lists.  Verification, detection and
    timings are optional, as tables and per run; verification may also be columns of
    ``children`` (True).
    """
    joined = heads.join(children, "run", "left")
    joined = joined.withColumns(
        {kind: F.coalesce(kind, F.array()) for kind in ("errors", "fixes", "cases")}
    )
    parts = {}
    if verification is not None:
        joined = joined if verification is True else joined.join(verification, "run", "left")
        parts["verification"] = verification_struct(F.lit(None) if command is None else command)
    if detection is not None:
        joined = joined.join(detection, "run", "left")
        parts["detection"] = detection_struct()
    if timings is not None:
        joined = joined.join(timings, "run", "left")
        parts["timings"] = timings_struct()
    none = F.lit(None)
    return joined.select(
        F.lit(1).alias("schemaVersion"),
        F.col("run").cast("string").alias("id"),
        F.col("title").alias("title"),
        F.col("file_name").alias("fileName"),
        "language",
        F.struct(
            F.col("kind"), F.col("model"), F.col("recorded_at").alias("recordedAt"), F.col("author")
        ).alias("source"),
        F.col("original_code").alias("originalCode"),
        F.struct("errors", "risk_level", F.col("analysis_summary").alias("summary")).alias("analysis"),
        F.struct(F.col("fixed_code").alias("fixedCode"), "fixes").alias("fix"),
        F.struct(
            F.col("framework"), F.col("test_code").alias("code"), "cases"
        ).alias("tests"),
        F.struct(F.col("report_summary").alias("summary"), "recommendations").alias("report"),
        parts.get("verification", none).cast(S.VERIFICATION).alias("verification"),
        parts.get("detection", none).cast(S.DETECTION).alias("detection"),
        parts.get("timings", none).cast(S.TIMINGS).alias("timings"),
    )


def _or_null(value: Column) -> Column:
    """A value that is written as null when it has none; plain NULLs are left out by to_json."""
    return F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))


def _plain_number(value: Column) -> Column:
    """A double as JSON writes it: whole numbers without a fraction."""
    whole = (value == F.rint(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("variant")).otherwise(value.cast("variant"))


def report_json(indent: int | None = None) -> Column:
    """A report row as one JSON text that passes the report schema; laid out from ``indent`` columns on, or compact.

    Absent optional fields are left out, absent lines and issue ids are null.
    """
    names = T.DataType.fromDDL(S.REPORT).names
    if indent is not None:
        return json_of(f"struct({', '.join(names)})", S.REPORT, indent)

    def with_null(items: str, field: str) -> Column:
        return F.transform(items, lambda e: e.withField(field, _or_null(e[field])))

    spans = [f"{stage}Ms" for stage in (*S.STAGES, "total")]
    timings = F.struct(*[_plain_number(F.col(f"timings.{n}")).alias(n) for n in spans], F.col("timings.method"))
    changed = {
        "analysis": F.col("analysis").withField("errors", with_null("analysis.errors", "line")),
        "tests": F.col("tests").withField("cases", with_null("tests.cases", "issueId")),
        "timings": F.when(F.col("timings").isNotNull(), timings),
    }
    return F.to_json(F.struct(*[changed.get(n, F.col(n)).alias(n) for n in names]))


# --- from reports -----------------------------------------------------------


def _children(reports: DataFrame, items: str, fields: dict[str, str]) -> DataFrame:
    rows = reports.select(F.col("id").alias("run"), F.posexplode(items).alias("pos", "_item"))
    return rows.select(
        "run",
        F.col("pos").cast("bigint").alias("pos"),
        *[F.col(f"_item.{name}").alias(c) for name, c in fields.items()],
    )


def flatten_issues(reports: DataFrame) -> DataFrame:
    return _children(reports, "analysis.errors", ISSUE_FIELDS)


def flatten_fixes(reports: DataFrame) -> DataFrame:
    return _children(reports, "fix.fixes", FIX_FIELDS)


def flatten_cases(reports: DataFrame) -> DataFrame:
    return _children(reports, "tests.cases", CASE_FIELDS)


def flatten_test_runs(reports: DataFrame) -> DataFrame:
    """Two rows per verified report, one per version."""
    sides = F.array(
        *[
            F.struct(F.lit(v).alias("version"), *[F.col(f"verification.{v}.{c}").alias(c) for c in ("passed", "failed", "total")])
            for v in S.VERSIONS
        ]
    )
    verified = reports.filter(F.col("verification").isNotNull())
    return verified.select(F.col("id").alias("run"), F.inline(sides))


def index_rows(heads: DataFrame, issues: DataFrame) -> DataFrame:
    """The index entry of every run from flat tables: issues are counted, not gathered."""
    counts = issues.groupBy("run").agg(F.count("*").alias("issues"))
    return heads.join(counts, "run", "left").select(
        F.col("run").cast("string").alias("id"),
        F.col("file_name").alias("fileName"),
        F.col("recorded_at").alias("recordedAt"),
        "author",
        F.coalesce("issues", F.lit(0).cast("bigint")).alias("issues"),
    )


def index_entries(reports: DataFrame) -> DataFrame:
    """The same from report documents."""
    return reports.select(
        "id",
        "fileName",
        F.col("source.recordedAt").alias("recordedAt"),
        F.col("source.author").alias("author"),
        F.size("analysis.errors").cast("bigint").alias("issues"),
    )


def card_of(df: DataFrame) -> DataFrame:
    """The card from one row of figures per run."""
    return df.select(
        "run",
        "issues",
        severity_label("high", "medium", "low").alias("severities"),
        "fixes",
        "cases",
        caught_label("caught", "expected").alias("bugs_caught"),
        missed_label("missed").alias("bugs_missed"),
        before_after_label("original_passed", "fixed_passed").alias("tests_passing"),
        "fixed_total",
        fmt_secs("total_ms").alias("pipeline_time"),
    )


def report_card(reports: DataFrame) -> DataFrame:
    """All key figures of a report document in one row; a plain projection."""
    errors = F.col("analysis.errors")

    def of_severity(severity):
        return F.size(F.filter(errors, lambda e: e["severity"] == severity)).alias(severity.lower())

    by_severity = [of_severity(s) for s in ("High", "Medium", "Low")]
    return card_of(
        reports.select(
            F.col("id").alias("run"),
            F.size(errors).cast("bigint").alias("issues"),
            *by_severity,
            F.size("fix.fixes").cast("bigint").alias("fixes"),
            F.size("tests.cases").cast("bigint").alias("cases"),
            F.col("detection.expected"),
            F.col("detection.caught"),
            F.col("detection.missed"),
            F.col("verification.original.passed").alias("original_passed"),
            F.col("verification.fixed.passed").alias("fixed_passed"),
            F.col("verification.fixed.total").alias("fixed_total"),
            F.col("timings.totalMs").alias("total_ms"),
        )
    )


def headline_values() -> Column:
    """Figures of a report row for the placeholders of a slide; what is absent becomes a dash.

    For ``text.fill_placeholders``.  The names are fixed values.
    """
    figures = {
        "ISSUES": F.size("analysis.errors"),
        "FIXED": F.size("fix.fixes"),
        "TESTS": F.col("verification.fixed.total"),
        "ORIG_PASS": F.col("verification.original.passed"),
        "FIXED_PASS": F.col("verification.fixed.passed"),
        "CAUGHT": F.col("detection.caught"),
        "EXPECTED": F.col("detection.expected"),
    }
    pairs = [x for name, value in figures.items() for x in (F.lit(name), or_dash(value))]
    return F.create_map(*pairs, F.lit("TIME"), fmt_time("timings.totalMs"))


def report_card_rows(
    runs: DataFrame,
    issues: DataFrame,
    fixes: DataFrame,
    cases: DataFrame,
    verification: DataFrame,
    detection: DataFrame,
    timings: DataFrame,
) -> DataFrame:
    """The same card from flat tables, without nesting them first."""
    none = F.lit(None).cast("string")
    tagged = (
        issues.select("run", F.lit("issue").alias("kind"), "severity")
        .unionByName(fixes.select("run", F.lit("fix").alias("kind"), none.alias("severity")))
        .unionByName(cases.select("run", F.lit("case").alias("kind"), none.alias("severity")))
    )
    counts = tagged.groupBy("run").agg(
        F.count_if(F.col("kind") == "issue").alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("High", "Medium", "Low")],
        F.count_if(F.col("kind") == "fix").alias("fixes"),
        F.count_if(F.col("kind") == "case").alias("cases"),
    )
    joined = runs.select("run").join(counts, "run", "left")
    for table in (verification, detection, timings):
        joined = joined.join(table, "run", "left")
    return card_of(joined.na.fill(0, ["issues", "high", "medium", "low", "fixes", "cases"]))
