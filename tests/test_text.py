import samples
from pyspark.sql import functions as F

from reviewlake.functions import labels as L
from reviewlake.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_lines_keep_the_empty_last_line(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "")], "id int, code string")
    rows = [tuple(r) for r in T.to_lines(df, "code").orderBy("id", "line_no").collect()]
    assert rows == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]


def test_number_lines(spark):
    assert one(spark, T.number_lines("code"), code="x\n\ny") == "1| x\n2| \n3| y"


def test_template_is_filled_in_one_pass(spark):
    values = F.create_map(
        F.lit("a"), F.lit("{{b}} $1 \\"), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None).cast("string")
    )
    template = "{{a}}|{{b}}|{{c}}|{{d}}|{{ a }}|{{é}}|{{a}}"
    assert (
        one(spark, T.render_template("t", values), t=template)
        == "{{b}} $1 \\||{{c}}|{{d}}|{{ a }}|{{é}}|{{b}} $1 \\"
    )
    assert one(spark, T.fill_placeholders("t", values), t=template) == "{{b}} $1 \\||–|–|{{ a }}|–|{{b}} $1 \\"
    assert one(spark, T.render_template("t", values), t="none") == "none"
    assert one(spark, T.render_template("t", values), t="") == ""


def test_case_titles_of_the_sample(spark):
    df = spark.createDataFrame([("r", samples.test_code())], "run string, code string")
    rows = T.extract_cases(df, "code", "run").orderBy("pos").collect()
    assert [(r.pos, r.name, r.issue_id) for r in rows] == [
        (i, n, t) for i, (n, t) in enumerate(zip(samples.titles(), samples.TAGS))
    ]


def test_case_title_quirks(spark):
    code = "\n".join(
        [
            "it.only('no', f); xit('no', f); _it('no', f); éit('yes', f)",
            "it('it\\'s cut', f)",
            'it(\n  "double [E12] [E3]", f); it(`back "quoted"`, f)',
            "it('broken\n line', f)",
            "it( 'nbsp', f); it('e1 [e1] [E] [X2]', f) it('a\u0085b', f)",
        ]
    )
    titles = one(spark, T.case_titles("code"), code=code)
    assert titles == [
        "yes", "it\\", "double [E12] [E3]", 'back "quoted"', "nbsp", "e1 [e1] [E] [X2]", "a\u0085b",
    ]
    df = spark.createDataFrame([(t,) for t in titles], "name string").select(T.issue_tag("name").alias("t"))
    assert [r.t for r in df.collect()] == [None, None, "E12", None, None, None, None]


def test_file_meta(spark):
    paths = ["a\\b/cart.ts", "x.d.ts", "UP.TS", ".ts", "noext", "dir.ts/file", "a.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = [(r.name, r.ext, r.language, r.file_name) for r in T.file_meta(df, "path").collect()]
    assert rows == [
        ("cart", ".ts", "typescript", "a/b/cart.ts"),
        ("x.d", ".ts", "typescript", "x.d.ts"),
        ("UP", ".TS", "javascript", "UP.TS"),
        (".ts", "", "javascript", ".ts"),
        ("noext", "", "javascript", "noext"),
        ("file", "", "javascript", "dir.ts/file"),
        ("a", ".js", "javascript", "a.js"),
    ]


def test_trim_and_length_follow_javascript(spark):
    space = T.JS_SPACE_CHARS
    assert len(space) == 25
    assert one(spark, T.trim_js("x"), x=f"{space}a{space}b{space}") == f"a{space}b"
    assert one(spark, T.trim_js("x"), x="\u0085a​") == "\u0085a​"
    assert one(spark, T.trim_js("x"), x=space) == ""
    assert one(spark, T.js_length("x"), x="aé😀") == 4


def test_normalise_eol(spark):
    assert one(spark, T.normalise_eol("x"), x="a\r\nb\rc\n") == "a\nb\rc\n"


def test_iso_time(spark):
    text = "2026-09-27T14:19:07.129Z"
    assert one(spark, T.iso_time(T.parse_iso("x")), x=text) == text
    assert one(spark, T.parse_iso("x"), x="soon") is None


def test_durations(spark):
    df = spark.createDataFrame([(0,), (49,), (50,), (1150,), (2500,), (3500,), (59999,), (60000,), (63000,), (None,)], "ms bigint")
    rows = [tuple(r) for r in df.select(L.fmt_secs("ms"), L.fmt_time("ms")).collect()]
    assert rows == [
        ("0.0s", "0s"), ("0.0s", "0s"), ("0.1s", "0s"), ("1.2s", "1s"), ("2.5s", "2s"), ("3.5s", "4s"),
        ("60.0s", "60s"), ("60.0s", "1.0 min"), ("63.0s", "1.1 min"), (None, "1 task"),
    ]
    assert one(spark, L.fmt_secs("ms"), ms=1234.5) == "1.2s"


def test_labels(spark):
    none = F.lit(None).cast("array<string>")
    labels = F.array(
        L.caught_label(F.lit(4), F.lit(5)),
        L.missed_label(F.array(F.lit("a"), F.lit("b"))),
        L.missed_label(F.array().cast("array<string>")),
        L.missed_label(none),
        L.before_after_label(F.lit(3), F.lit(12)),
        L.severity_label(F.lit(2), F.lit(2), F.lit(1)),
        L.guard_label(F.lit("E1")),
        L.guard_label(F.lit("")),
        L.guard_label(F.lit(None).cast("string")),
        L.or_dash(F.lit(None).cast("string")),
    )
    assert one(spark, labels) == [
        "4/5", "missed: a, b", "none missed", None, "3 → 12", "2 high · 2 medium · 1 low",
        "guards E1", "edge / happy path", "edge / happy path", "–",
    ]
