"""The test tables in the role of review data.

The driver's tables hold orders, events and documents.  These functions give
them the columns the operators expect: an order is a run, its line numbers are
source lines, return flags are severities, and so on.  Every row takes part.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import iso_time
from reviewlake.schemas import RECORDED, STAGES, VERSIONS


HEAD_COLUMNS = ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"]
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Those columns of a table, its rows dealt out evenly over the session's shuffle partitions, whatever the files they lie in.

    For steps with much work per row: a small file, or one with large row groups, is read by one task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(tasks)


# --- lineitem: issues, bugs, fixes, cases ------------------------------------


def severity():
    return F.when(F.col("flag") == "R", "High").when(F.col("flag") == "A", "Medium").otherwise("Low")


def issue_lines(lineitem: DataFrame) -> DataFrame:
    """Reported lines: returned rows of a large quantity."""
    return lineitem.filter("l_returnflag = 'R' AND l_quantity > 25").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("bigint").alias("line")
    )


def truth(lineitem: DataFrame) -> DataFrame:
    """Seeded bugs: open rows, one per line."""
    line = F.col("l_linenumber").cast("bigint")
    bugs = lineitem.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("run"), line.alias("line"))
    return bugs.distinct().select(
        "run",
        (F.col("line") - 1).alias("pos"),
        F.concat(F.lit("B"), F.col("line").cast("string")).alias("bug_id"),
        "line",
    )


def line_facts(lineitem: DataFrame) -> DataFrame:
    """Everything there is on one (order, line number), in one aggregation: its issue, its fix, its case, test results, time.

    Of several rows the last flag counts.  Flags and states are ranked as numbers, which aggregate without sorting.
    """
    flag, ran = F.col("l_returnflag"), F.col("l_orderkey") % 7 != 3
    of = {"original": F.col("l_linestatus") == "F", "fixed": F.col("l_linestatus") != "F"}
    tests = [
        F.count_if(of[v] & condition).alias(f"{v}_{c}")
        for v in VERSIONS
        for c, condition in {"rows": F.lit(True), "passed": ran & (flag == "N"), "failed": ran & (flag == "R"), "total": ran}.items()
    ]
    per_line = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.when(flag == "R", 3).when(flag == "N", 2).otherwise(1)).alias("flag"),
        F.max(F.col("l_linestatus") == "O").alias("open"),
        F.min("l_partkey").alias("part"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        *tests,
    )
    line = F.col("l_linenumber").cast("bigint")
    rank = F.col("flag")
    rows = per_line.select(
        F.col("l_orderkey").alias("run"),
        (line - 1).alias("pos"),
        F.concat(F.lit("E"), line.cast("string")).alias("issue_id"),
        F.lit("Logical").alias("type"),
        F.concat(F.lit("part "), F.col("part").cast("string")).alias("description"),
        line.alias("line"),
        F.when(rank == 3, "High").when(rank == 2, "Low").otherwise("Medium").alias("severity"),
        F.when(F.col("part") % 2 == 0, F.lit("replace it")).alias("suggestion"),
        (~F.col("open")).alias("fixed"),
        "part",
        "quantity",
        *[f"{v}_{c}" for v in VERSIONS for c in ("rows", "passed", "failed", "total")],
    )
    return rows.withColumns(
        {
            "change": F.concat(F.lit("fixed "), "description"),
            "name": F.when(F.col("fixed"), F.concat(F.lit("["), "issue_id", F.lit("] "), "description")).otherwise(F.col("description")),
            "case_issue_id": F.when(F.col("fixed"), F.col("issue_id")),
        }
    )


def issues(lineitem: DataFrame) -> DataFrame:
    """One issue per (order, line number)."""
    return line_facts(lineitem).select(
        "run", "pos", "issue_id", "type", "description", "line", "severity", "suggestion", "fixed", "part"
    )


def test_sums() -> list[Column]:
    """Test results per run as aggregates over ``line_facts``, as ``before_after`` has them."""
    out = []
    for v in VERSIONS:
        there = F.sum(f"{v}_rows") > 0
        out += [F.when(there, F.sum(f"{v}_{c}")).alias(f"{v}_{c}") for c in ("passed", "failed", "total")]
    return out


def total_ms(quantity: Column) -> Column:
    """Total time of a run from its quantities; none for runs of even totals."""
    ms = quantity * 731
    return F.when(ms % 2 == 1, ms)


def fixes(issue_rows: DataFrame) -> DataFrame:
    """Fixes: issues whose rows are all filled."""
    return issue_rows.filter("fixed").select(
        "run", "pos", "issue_id", F.concat(F.lit("fixed "), "description").alias("change")
    )


def cases(issue_rows: DataFrame) -> DataFrame:
    """A tagged case for every fixed issue, an untagged one for the others."""
    tagged = F.col("fixed")
    name = F.when(tagged, F.concat(F.lit("["), "issue_id", F.lit("] "), "description")).otherwise(
        F.col("description")
    )
    return issue_rows.select(
        "run", "pos", name.alias("name"), F.when(tagged, F.col("issue_id")).alias("issue_id")
    )


def test_runs(lineitem: DataFrame) -> DataFrame:
    """Test results: filled rows on the original, open rows on the fixed version.

    Every seventh run crashed, so it reports no tests.
    """
    version = F.when(F.col("l_linestatus") == "F", "original").otherwise("fixed")
    ran = F.col("l_orderkey") % 7 != 3
    return lineitem.groupBy(F.col("l_orderkey").alias("run"), version.alias("version")).agg(
        F.count_if(ran & (F.col("l_returnflag") == "N")).alias("passed"),
        F.count_if(ran & (F.col("l_returnflag") == "R")).alias("failed"),
        F.count_if(ran).alias("total"),
    )


def run_files(lineitem: DataFrame) -> DataFrame:
    """Artifact files: the line number says which one, the order key the extension."""
    ext = F.when(F.col("l_orderkey") % 2 == 0, ".ts").otherwise(".js")
    n = F.col("l_linenumber")
    file = (
        F.when(n == 1, "analysis.json")
        .when(n == 2, F.concat(F.lit("fixed"), ext))
        .when(n == 3, "fixes.json")
        .when(n == 4, "cart.test.ts")
        .when(n == 5, "report.json")
        .when(n == 6, F.concat(F.lit("original"), ext))
        .otherwise("meta.json")
    )
    return lineitem.select(F.col("l_orderkey").alias("run"), file.alias("file"))


def runs(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("run"),
        F.when(F.col("o_orderkey") % 2 == 0, ".ts").otherwise(".js").alias("ext"),
    )


def risk():
    return (
        F.when(F.col("o_orderpriority").startswith("1"), "High")
        .when(F.col("o_orderpriority").startswith("5"), "Low")
        .otherwise("Medium")
    )


def heads(orders: DataFrame) -> DataFrame:
    """Everything of a report that is not a list of children."""
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("run"),
        F.concat(F.lit("order "), key).alias("title"),
        F.concat(F.lit("src/order"), key, F.lit(".ts")).alias("file_name"),
        F.lit("typescript").alias("language"),
        F.lit(RECORDED).alias("kind"),
        F.lit("manual").alias("model"),
        iso_time(F.col("o_orderdate").cast("timestamp")).alias("recorded_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("author"),
        F.concat(F.lit("// "), "o_orderpriority", F.lit("\nbefore")).alias("original_code"),
        F.concat(F.lit("// "), "o_orderpriority", F.lit("\nafter")).alias("fixed_code"),
        risk().alias("risk_level"),
        F.concat(F.lit("priority "), "o_orderpriority").alias("analysis_summary"),
        F.lit("vitest").alias("framework"),
        F.lit("").alias("test_code"),
        F.concat(F.lit("status "), "o_orderstatus").alias("report_summary"),
        F.array(F.lit("check it"), F.col("o_orderpriority")).alias("recommendations"),
    )


# --- events -------------------------------------------------------------------

def status():
    return (
        F.when(F.col("event_type").isin("click", "view"), "running")
        .when(F.col("event_type").isin("purchase", "signup"), "done")
        .otherwise("error")
    )


def stage_name(number):
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), (number + 1).cast("int"))


def progress_events(events: DataFrame) -> DataFrame:
    """All events as stage events of their user's run."""
    return events.select(
        F.col("user_id").alias("run"),
        F.struct("ts", "event_id").alias("seq"),
        F.lit("stage").alias("type"),
        stage_name(F.col("event_id") % 4).alias("stage"),
        status().alias("status"),
        F.when(status() == "done", F.round(F.col("value") * 100).cast("bigint")).alias("ms"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def run_events(events: DataFrame) -> DataFrame:
    """Errors end a run, purchases carry a report, the rest are stage events."""
    kind = F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "purchase", "result"
    ).otherwise("stage")
    return events.select(
        F.col("user_id").alias("run"),
        F.struct("ts", "event_id").alias("seq"),
        kind.alias("type"),
        stage_name(F.col("event_id") % 4).alias("stage"),
        status().alias("status"),
        F.when(kind == "stage", F.round(F.col("value") * 100).cast("bigint")).alias("ms"),
        F.when(kind == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("message"),
        F.when(kind == "result", F.col("props")).alias("report"),
    )


def stamps(events: DataFrame) -> DataFrame:
    """Six events in a row are one run: its start and its five artifacts.

    Every fifth run has its first and its last artifact swapped.
    """
    kinds = ["start", "analysis", "fixed", "fixes", "tests", "report"]
    run = F.floor(F.col("event_id") / 6)
    n = F.col("event_id") % 6
    swapped = F.when((run % 5 == 0) & (n == 1), 5).when((run % 5 == 0) & (n == 5), 1).otherwise(n)
    return events.select(
        run.alias("run"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (swapped + 1).cast("int")).alias("artifact"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def responses(events: DataFrame) -> DataFrame:
    """Twelve events in a row are one run: four stages of three attempts.

    Errors lost their closing brace, sign-ups hold text for a number.
    """
    e = F.col("event_id")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("note "), F.replace("props", F.lit("}"), F.lit(""))))
        .when(F.col("event_type") == "signup", F.lit('note {"k": "x"} end'))
        .otherwise(F.concat(F.lit("note "), "props", F.lit(" end")))
    )
    started = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.floor(e / 12).alias("run"),
        stage_name(F.floor(e / 3) % 4).alias("stage"),
        (e % 3 + 1).alias("attempt"),
        text.alias("text"),
        started.alias("started"),
        (started + F.round(F.col("value") * 1000).cast("bigint")).alias("ended"),
    )


def result_files(orders: DataFrame) -> DataFrame:
    """Two result files per order; some are cut off, some hold a fraction or lack a count."""
    k = F.col("o_orderkey")
    version = F.explode(F.array(F.lit("original"), F.lit("fixed"), F.lit("draft")))
    rows = orders.select(k.cast("string").alias("run"), k.alias("k"), version.alias("version"))
    k = F.col("k")
    number = (k % 10).cast("string")
    text = (
        F.when(k % 13 == 1, F.concat(F.lit('{"numPassedTests": '), number))
        .when(k % 13 == 2, F.concat(F.lit('{"numPassedTests": '), number, F.lit('.5, "numFailedTests": 0, "numTotalTests": 1}')))
        .when(k % 13 == 3, F.concat(F.lit('{"numPassedTests": '), number, F.lit(', "numTotalTests": 1}')))
        .otherwise(
            F.concat(
                F.lit('{"numTotalTests": 12, "numPassedTests": '), number, F.lit(', "numFailedTests": '),
                F.when(F.col("version") == "fixed", "0").otherwise("2.0"), F.lit(', "other": [1, {}]}'),
            )
        )
    )
    file = F.concat(F.lit("vitest-"), "version", F.lit(".json"))
    return rows.select("run", file.alias("file"), text.alias("text"))


def truth_lists(orders: DataFrame) -> DataFrame:
    """Ground truth as lists: up to four bugs per order, maybe none."""
    k = F.col("o_orderkey")
    numbers = F.filter(F.array(*[F.lit(n) for n in range(4)]), lambda n: n < k % 5)
    bug = F.transform(
        numbers,
        lambda n: F.struct(
            F.concat(F.lit("bug-"), n.cast("string")).alias("id"),
            (k % 40 + n * 3).cast("bigint").alias("line"),
            F.when(n != 1, F.col("o_orderpriority")).alias("description"),
        ),
    )
    return orders.select(k.alias("run"), bug.alias("bugs"))


def event_texts(events: DataFrame) -> DataFrame:
    """Events as lines of text; some are no JSON, some have values of other kinds."""
    e = F.col("event_id")
    ms = F.round(F.col("value") * 100).cast("bigint").cast("string")
    line = (
        F.when(e % 17 == 3, F.concat(F.lit("oops "), e.cast("string")))
        .when(e % 17 == 4, F.lit('{"type": "error", "message": "stopped"} x'))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"type": "error", "message": "failed at '), e.cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"type":"result","report":'), "props", F.lit("}")))
        .otherwise(
            F.concat(
                F.lit('{"type": "stage", "stage": "'), stage_name(e % 4), F.lit('", "status": "'), status(),
                F.lit('", "ms": '), F.when(e % 2 == 0, ms).otherwise("null"), F.lit("}"),
            )
        )
    )
    return events.select(e.alias("event_id"), line.alias("line"))


# --- documents ----------------------------------------------------------------


def version_pairs(documents: DataFrame) -> DataFrame:
    """Documents with the same first line are versions of one file.

    The lowest id is the original; each other one is compared with it, so a
    group of n gives n - 1 pairs.
    """
    titled = documents.select(
        F.col("doc_id"), "source", "text", F.substring_index("text", "\n", 1).alias("title")
    )
    firsts = (
        titled.groupBy("title")
        .agg(F.min("doc_id").alias("base_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    bases = titled.join(firsts.select(F.col("base_id").alias("doc_id")), "doc_id").select(
        "title", F.col("doc_id").alias("base_id"), F.col("text").alias("left")
    )
    others = titled.select("title", "doc_id", "source", F.col("text").alias("right"))
    return (
        others.join(bases, "title")
        .filter("doc_id <> base_id")
        .select("base_id", "doc_id", "source", "left", "right")
    )
