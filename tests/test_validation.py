import copy
import json

import pytest
import samples
from pyspark.sql import functions as F

from reviewlake.functions import strict_json as J
from reviewlake.operators import validation as V

GOOD_JSON = ['{"a":{}}', "[1, 2]", "1.50", '"x"', "null", "true", ' {"a":1}\n', '{"a":"\\u0000"}', '{"a":1,"a":2}', '"\x7fend-of-value\x7f"']
BAD_JSON = [
    '{"a":{}} post }', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', "1],[2", "{'a':1}", '{"a":NaN}', '{"a":01}',
    '{"a":1,}', '{"a":1} // x', "{a:1}", '{"a":"x\ny"}', "", "  ", '1,"\x7fend-of-value\x7f"],[1', "1 2", "+1", ".5",
]


def test_strict_json(spark):
    df = spark.createDataFrame([(x,) for x in GOOD_JSON + BAD_JSON], "x string")
    rows = df.select("x", J.parse_strict("x").isNotNull().alias("ok")).collect()
    assert [r.x for r in rows if r.ok] == GOOD_JSON


def test_last_of_repeated_keys_wins(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "x string")
    value = J.parse_strict("x")
    assert df.select(F.to_json(value)).first()[0] == '{"a":2}'


def test_extract_json(spark):
    texts = ['```json\n{"a": {"b": 1}}\n```', "no braces", "} {", "{", 'x {"a":1} y {"b":2} z', '{"a":1}', "{}", "a } b { c"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    rows = V.extract_json(df, "x").select(F.to_json("value"), "reason").collect()
    assert [tuple(r) for r in rows] == [
        ('{"a":{"b":1}}', None), (None, "no_object"), (None, "no_object"), (None, "no_object"),
        (None, "bad_json"), ('{"a":1}', None), ("{}", None), (None, "no_object"),
    ]


def changed(path, value):
    """The sample report with one value replaced, or dropped when it is ``...``."""
    doc = copy.deepcopy(samples.report())
    *outer, last = path
    at = doc
    for step in outer:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return json.dumps(doc)


FIRST = ("analysis", "errors", 0)
CASES = [
    ((*FIRST, "line"), None, None),
    ((*FIRST, "line"), 12.0, None),
    ((*FIRST, "line"), 1e3, None),
    ((*FIRST, "line"), -1, None),
    ((*FIRST, "line"), 2**53 - 1, None),
    ((*FIRST, "line"), 2**53, "analysis.errors.0.line"),
    ((*FIRST, "line"), 12.5, "analysis.errors.0.line"),
    ((*FIRST, "line"), "12", "analysis.errors.0.line"),
    ((*FIRST, "line"), True, "analysis.errors.0.line"),
    ((*FIRST, "line"), ..., "analysis.errors.0.line"),
    ((*FIRST, "suggestion"), ..., None),
    ((*FIRST, "suggestion"), None, "analysis.errors.0.suggestion"),
    ((*FIRST, "severity"), "high", "analysis.errors.0.severity"),
    ((*FIRST, "type"), 1, "analysis.errors.0.type"),
    (("analysis", "errors", 3, "id"), 4, "analysis.errors.3.id"),
    (("analysis", "errors", 2), "x", "analysis.errors.2"),
    (("analysis", "errors", 2), None, "analysis.errors.2"),
    (("analysis", "errors"), [], None),
    (("analysis", "errors"), {}, "analysis.errors"),
    (("analysis", "errors"), ..., "analysis.errors"),
    (("analysis",), [], "analysis"),
    (("extra",), {"any": 1}, None),
    (("schemaVersion",), 2, "schemaVersion"),
    (("schemaVersion",), 1.0, None),
    (("schemaVersion",), "1", "schemaVersion"),
    (("language",), "Typescript", "language"),
    (("source", "kind"), "other", "source.kind"),
    (("source", "author"), ..., None),
    (("source", "author"), None, "source.author"),
    (("tests", "cases", 0, "issueId"), None, None),
    (("tests", "cases", 0, "issueId"), ..., "tests.cases.0.issueId"),
    (("report", "recommendations", 1), 5, "report.recommendations.1"),
    (("verification",), ..., None),
    (("verification",), None, "verification"),
    (("verification", "fixed", "total"), 1.5, "verification.fixed.total"),
    (("detection", "missed"), ["a"], None),
    (("detection", "missed"), [None], "detection.missed.0"),
    (("timings",), {"analyzeMs": 1.5, "fixMs": 0, "testMs": 2, "reportMs": 3, "totalMs": 1e2, "method": "m"}, None),
    (("timings",), {"analyzeMs": 1.5}, "timings.fixMs"),
]


def test_report_schema(spark):
    rows = [(i, changed(path, value)) for i, (path, value, _) in enumerate(CASES)]
    rows += [(100, "[]"), (101, "null"), (102, changed(("id",), "x") + "}"), (103, '{"schemaVersion":1e400}')]
    df = spark.createDataFrame(rows, "i int, text string")
    checked = V.check_json(df, "text", V.REPORT, "struct<id: string>", "report").orderBy("i").collect()
    got = {r.i: (r.reason, r.bad_path) for r in checked}
    for i, (path, value, bad) in enumerate(CASES):
        assert got[i] == (bad and "bad_field", bad), (path, value)
    assert got[100] == ("bad_field", "") and got[101] == ("bad_field", "")
    assert got[102] == ("bad_json", None) and got[103] == ("bad_field", "schemaVersion")


def test_all_bad_fields(spark):
    """Every single fault of the cases above at once, in the order of the shape; nothing below a fault that hides it."""
    doc = copy.deepcopy(samples.report())
    errors = doc["analysis"]["errors"]
    errors[0] |= {"line": 12.5, "severity": "high", "suggestion": None}
    errors[2] = "x"
    del errors[3]["id"]
    doc["source"] = {"kind": "other", "model": 1, "author": None}
    doc["schemaVersion"], doc["tests"]["cases"], doc["verification"]["fixed"]["total"] = 2, {}, "3"
    doc["report"]["recommendations"][1] = 5
    want = [
        "schemaVersion", "source.kind", "source.model", "source.recordedAt", "source.author", "analysis.errors.0.line",
        "analysis.errors.0.severity", "analysis.errors.0.suggestion", "analysis.errors.2", "analysis.errors.3.id", "tests.cases",
        "report.recommendations.1", "verification.fixed.total",
    ]
    texts = [(1, json.dumps(doc)), (2, json.dumps(samples.report())), (3, "[]"), (4, "{"), (5, '{"analysis": {"errors": []}}'), (6, None)]
    rows = V.bad_fields(spark.createDataFrame(texts, "i int, text string"), "text").orderBy("i", "pos").collect()
    assert [r.bad_path for r in rows if r.i == 1] == want
    assert [(r.i, r.bad_path) for r in rows if r.i in (2, 3, 4, 6)] == [(3, "")]
    assert [r.bad_path for r in rows if r.i == 5][:2] == ["schemaVersion", "id"] and [r.pos for r in rows if r.i == 5][:2] == [0, 1]
    assert {"analysis.risk_level", "analysis.summary", "fix", "report"} <= {r.bad_path for r in rows if r.i == 5}


def test_valid_report_is_read_with_its_types(spark):
    text = changed((*FIRST, "line"), 12.0)
    df = spark.createDataFrame([("a", text), ("b", "{")], "path string, text string")
    valid, rejected = V.validate_reports(df, "text")
    row = valid.first().report
    assert row.analysis.errors[0].line == 12 and row.timings is None
    assert row.verification.fixed.passed == 10 and row.detection.missed == []
    assert [(r.path, r.reason) for r in rejected.collect()] == [("b", "bad_json")]


def test_every_stage_answer_has_a_shape(spark):
    answers = {
        "analyze": samples.analysis(),
        "fix": samples.report()["fix"],
        "test": samples.report()["tests"],
        "report": samples.summary(),
    }
    for stage, (check, ddl) in V.STAGE_SHAPES.items():
        df = spark.createDataFrame(
            [(1, f"Here: {json.dumps(answers[stage])} done."), (2, "{}"), (3, "nothing")], "i int, text string"
        )
        rows = V.check_response(df, "text", check, ddl).orderBy("i").collect()
        assert [r.reason for r in rows] == [None, "bad_field", "no_object"]
        assert rows[0].value is not None and rows[1].value is None


def test_requests(spark):
    emoji = "😀" * 10_000
    rows = [
        (0, None, None, None), (1, " \n ", None, None), (2, "  x\n", None, None), (3, emoji, "javascript", "a.js"),
        (4, emoji + "x", None, None), (5, "x", "python", "f" * 121), (6, "x", None, "f" * 121), (7, "x", None, "f" * 120),
        (8, " " + "y" * 20_000 + " ", "typescript", None), (9, "y" * 20_001, "python", None),
    ]
    df = spark.createDataFrame(rows, "i int, code string, language string, file_name string")
    got = {r.i: r for r in V.check_requests(df).collect()}
    assert {i: got[i].reason for i in got} == {
        0: V.CODE_MISSING, 1: V.CODE_EMPTY, 2: None, 3: None, 4: V.CODE_TOO_LONG, 5: V.LANGUAGE_UNKNOWN,
        6: V.FILE_NAME_TOO_LONG, 7: None, 8: None, 9: V.CODE_TOO_LONG,
    }
    assert (got[2].code, got[2].language, got[2].file_name) == ("x", "typescript", "snippet.ts")
    valid, rejected = V.validate_requests(df)
    assert sorted(r.i for r in valid.collect()) == [2, 3, 7, 8] and rejected.count() == 6


@pytest.mark.parametrize("run, ok", [("cart-total", True), ("a_1", True), ("a b", False), ("a\n", False), ("", False), ("é", False)])
def test_run_ids(spark, run, ok):
    df = spark.createDataFrame([(run,)], "run string")
    assert (V.valid_run_ids(df).count() == 1) is ok
