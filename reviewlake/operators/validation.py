"""Validation with a quarantine: every operator returns valid and rejected rows."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions import strict_json as J
from reviewlake.functions.text import js_length, trim_js

MAX_CODE = 20_000
MAX_FILE_NAME = 120
DEFAULT_LANGUAGE = "typescript"
DEFAULT_FILE_NAME = "snippet.ts"

# What a rejected request is told.
CODE_MISSING = "Invalid input: expected string, received undefined"
CODE_EMPTY = "Paste some code first."
CODE_TOO_LONG = "Keep it under 20,000 characters."
LANGUAGE_UNKNOWN = 'Invalid option: expected one of "typescript"|"javascript"'
FILE_NAME_TOO_LONG = "Too big: expected string to have <=120 characters"


class Checked(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


# --- shapes of the artifacts -----------------------------------------------

_TEST_RUN = J.fields(passed=J.integer(), failed=J.integer(), total=J.integer())

ANALYSIS = J.fields(
    errors=J.list_of(
        J.fields(
            id=J.text(),
            type=J.one_of(S.ISSUE_TYPES),
            description=J.text(),
            line=J.nullable(J.integer()),
            severity=J.one_of(S.SEVERITIES),
            suggestion=J.optional(J.text()),
        )
    ),
    risk_level=J.one_of(S.SEVERITIES),
    summary=J.text(),
)
FIX_LIST = J.list_of(J.fields(issueId=J.text(), change=J.text()))
FIX = J.fields(fixedCode=J.text(), fixes=FIX_LIST)
TESTS = J.fields(
    framework=J.text(),
    code=J.text(),
    cases=J.list_of(J.fields(name=J.text(), issueId=J.nullable(J.text()))),
)
SUMMARY = J.fields(summary=J.text(), recommendations=J.list_of(J.text()))
REPORT = J.fields(
    schemaVersion=J.equals(1),
    id=J.text(),
    title=J.text(),
    fileName=J.text(),
    language=J.one_of(S.LANGUAGES),
    source=J.fields(
        kind=J.one_of(S.SOURCE_KINDS),
        model=J.optional(J.text()),
        recordedAt=J.text(),
        author=J.optional(J.text()),
    ),
    originalCode=J.text(),
    analysis=ANALYSIS,
    fix=FIX,
    tests=TESTS,
    report=SUMMARY,
    verification=J.optional(J.fields(command=J.text(), original=_TEST_RUN, fixed=_TEST_RUN)),
    detection=J.optional(
        J.fields(expected=J.integer(), caught=J.integer(), missed=J.list_of(J.text()))
    ),
    timings=J.optional(
        J.fields(
            analyzeMs=J.number(),
            fixMs=J.number(),
            testMs=J.number(),
            reportMs=J.number(),
            totalMs=J.number(),
            method=J.text(),
        )
    ),
)
# What each stage has to answer with.
STAGE_SHAPES = {
    "analyze": (ANALYSIS, S.ANALYSIS),
    "fix": (FIX, S.FIX),
    "test": (TESTS, S.TESTS),
    "report": (SUMMARY, S.SUMMARY),
}


# --- operators --------------------------------------------------------------


def _checked(
    df: DataFrame, text: str, missing: Column, check: J.Check, typed: str, out: str
) -> DataFrame:
    """Add ``reason``, ``bad_path`` and the typed ``out`` of one JSON text per row.

    Parsing, checking and reading sit in generators, so each runs once per row;
    filters on a result stay above it instead of repeating it.
    """

    def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
        return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))

    parsed = once(df, J.parse_listed(text), "_v")
    found = F.col("_v").isNotNull()
    checked = once(parsed, F.when(found, J.first_bad_path(J.Value("_v", "$[0]"), check)), "bad_path")
    good = found & F.col("bad_path").isNull()
    read = once(checked, F.when(good, F.try_variant_get("_v", "$[0]", typed)), out)
    reason = F.when(~found, missing).when(F.col("bad_path").isNotNull(), "bad_field")
    return read.select(*df.columns, reason.alias("reason"), "bad_path", out)


def check_json(df: DataFrame, text: str, check: J.Check, typed: str, out: str = "value") -> DataFrame:
    """Parse strictly, check the shape, and read the value with its schema.

    Adds ``reason`` (``bad_json``, ``bad_field`` or NULL), ``bad_path`` and the
    typed ``out``, which is NULL unless the whole value is valid.
    """
    return _checked(df, text, F.lit("bad_json"), check, typed, out)


def bad_fields(df: DataFrame, text: str, check: J.Check = REPORT) -> DataFrame:
    """Every bad field of JSON texts as a row: the other columns, ``pos`` and ``bad_path`` ('' is the whole document).

    ``pos`` counts the bad fields of a document from 0, in the order of the shape; the first one is what ``check_json``
    names.  Only documents that ``check_json`` rejects for a field are looked through again.
    """
    others = [c for c in df.columns if c != text]
    # As in _checked, each step is done once for a row.
    parsed = df.select("*", F.inline(F.array(F.struct(J.parse_listed(text).alias("_v")))))
    value = J.Value("_v", "$[0]")
    first = F.when(F.col("_v").isNotNull(), J.first_bad_path(value, check))
    bad = parsed.select("*", F.inline(F.array(F.struct(first.alias("_first"))))).filter("_first IS NOT NULL")
    found = bad.select(*others, F.posexplode(J.bad_paths(value, check)).alias("pos", "bad_path"))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def split_checked(df: DataFrame, out: str = "value") -> Checked:
    valid = df.filter(F.col("reason").isNull()).drop("reason", "bad_path")
    rejected = df.filter(F.col("reason").isNotNull()).drop(out)
    return Checked(valid, rejected)


def validate_reports(df: DataFrame, text: str) -> Checked:
    """Report documents as text to typed ``report`` rows, the rest with the reason."""
    return split_checked(check_json(df, text, REPORT, S.REPORT, "report"), "report")


def extract_json(df: DataFrame, text: str) -> DataFrame:
    """Add ``value`` (VARIANT) of the outermost object in a text, and the ``reason`` if none."""
    spans = df.withColumn("_span", J.object_text(text))
    parsed = spans.withColumn("value", J.parse_strict("_span"))
    reason = F.when(F.col("_span").isNull(), "no_object").when(F.col("value").isNull(), "bad_json")
    return parsed.withColumn("reason", reason).drop("_span")


def check_response(df: DataFrame, text: str, check: J.Check, typed: str, out: str = "value") -> DataFrame:
    """``extract_json`` followed by the shape check: a stage's raw answer to a typed value."""
    spans = df.withColumn("_span", J.object_text(text))
    missing = F.when(F.col("_span").isNull(), "no_object").otherwise("bad_json")
    return _checked(spans, "_span", missing, check, typed, out).drop("_span")


def request_problem(code: Column, language: Column, file_name: Column) -> Column:
    """Message of the first failing field of a request; NULL when it is fine.

    ``code`` is already trimmed; an absent language or file name is fine.
    """
    # UTF-16 units are at most twice the characters, so most texts need no recoding.
    too_long = F.when(F.length(code) * 2 > MAX_CODE, js_length(code) > MAX_CODE).otherwise(False)
    name_too_long = F.when(F.length(file_name) * 2 > MAX_FILE_NAME, js_length(file_name) > MAX_FILE_NAME)
    return (
        F.when(code.isNull(), CODE_MISSING)
        .when(code == "", CODE_EMPTY)
        .when(too_long, CODE_TOO_LONG)
        .when(~language.isin(S.LANGUAGES), LANGUAGE_UNKNOWN)
        .when(name_too_long, FILE_NAME_TOO_LONG)
    )


def check_requests(df: DataFrame) -> DataFrame:
    """Requests(code, language, file_name) with trimmed code, defaults and ``reason``."""
    trimmed = df.withColumn("code", trim_js("code"))
    reason = request_problem(F.col("code"), F.col("language"), F.col("file_name"))
    return trimmed.withColumn("reason", reason).withColumns(
        {
            "language": F.coalesce("language", F.lit(DEFAULT_LANGUAGE)),
            "file_name": F.coalesce("file_name", F.lit(DEFAULT_FILE_NAME)),
        }
    )


def validate_requests(df: DataFrame) -> Checked:
    checked = check_requests(df)
    return Checked(
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def supported_files(df: DataFrame, ext: str = "ext") -> DataFrame:
    return df.filter(F.col(ext).isin(S.SUPPORTED_EXTENSIONS))


def valid_run_ids(df: DataFrame, run: str = "run") -> DataFrame:
    """Run ids of letters, digits, underscore and hyphen only."""
    return df.filter(F.col(run).rlike(r"\A[A-Za-z0-9_-]+\z"))
