"""Audit the contracts between the artifacts of a run.

Every rule yields one row per violation; ``contract_audit`` counts them per
rule and run in a single aggregation at the end.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import issue_tag, split_lines

MIN_RECOMMENDATIONS, MAX_RECOMMENDATIONS = 2, 4
MAX_WORDS = 20


def _violations(df: DataFrame, **rules: Column) -> DataFrame:
    """(rule, run) for every rule a row breaks."""
    rows = df.filter(reduce(Column.__or__, rules.values()))
    if len(rules) == 1:
        return rows.select(F.lit(*rules).alias("rule"), "run")
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), "run")


def issue_order(issues: DataFrame) -> DataFrame:
    """Ids are E1, E2, ... in document order."""
    expected = F.concat(F.lit("E"), (F.col("pos") + 1).cast("string"))
    return _violations(issues, ids_in_order=F.col("issue_id") != expected)


def issue_lines(issues: DataFrame, originals: DataFrame) -> DataFrame:
    """A line number refers to a line of originals(run, code), which is unique per run."""
    lengths = originals.select("run", F.size(split_lines("code")).alias("_n"))
    placed = issues.filter(F.col("line").isNotNull()).join(lengths, "run")
    return _violations(placed, line_exists=~F.col("line").between(1, F.col("_n")))


def clean_is_low(analyses: DataFrame, issues: DataFrame) -> DataFrame:
    """A run without issues has risk level Low."""
    raised = analyses.filter(F.col("risk_level") != "Low").select("run", F.lit(0).alias("n"))
    per_run = raised.unionByName(issues.select("run", F.lit(1).alias("n"))).groupBy("run").agg(
        F.max("n").alias("n")
    )
    return _violations(per_run, clean_is_low=F.col("n") == 0)


def issue_links(issues: DataFrame, fixes: DataFrame, cases: DataFrame) -> DataFrame:
    """Issues, fixes and tests that should refer to each other.

    Counted together per (run, issue id), so there is no join and a run with
    very many issues spreads over its ids.
    """
    zero, one = F.lit(0), F.lit(1)
    urgent = F.col("severity").isin("High", "Medium").cast("int")

    def part(df, issue=zero, urgent=zero, fix=zero, case=zero):
        return df.select(
            "run", "issue_id", issue.alias("i"), urgent.alias("u"), fix.alias("f"), case.alias("c")
        )

    tagged = (
        part(issues, issue=one, urgent=urgent)
        .unionByName(part(fixes, fix=one))
        .unionByName(part(cases.filter(F.col("issue_id").isNotNull()), case=one))
    )
    linked = tagged.groupBy("run", "issue_id").agg(
        F.sum("i").alias("i"), F.sum("u").alias("u"), F.sum("f").alias("f"), F.sum("c").alias("c")
    )
    i, u, f, c = (F.col(x) for x in "iufc")
    return _violations(
        linked,
        urgent_is_fixed=(u > 0) & (f == 0),
        one_fix_per_issue=f > 1,
        fix_of_known_issue=(f > 0) & (i == 0),
        fixed_is_tested=(i > 0) & (f > 0) & (c == 0),
    )


def tests_prove_fix(verification: DataFrame) -> DataFrame:
    """Tests fail on the original and pass on the fixed version."""
    proven = (F.col("fixed_failed") == 0) & (F.col("original_failed") > 0)
    return _violations(verification, tests_prove_fix=~F.coalesce(proven, F.lit(False)))


def declared_cases(declared: DataFrame, found: DataFrame) -> DataFrame:
    """The declared cases are exactly the titles found in the test text."""
    sides = declared.select("run", "name", F.lit(1).alias("d")).unionByName(
        found.select("run", "name", F.lit(-1).alias("d"))
    )
    balance = sides.groupBy("run", "name").agg(F.sum("d").alias("d"))
    return _violations(balance, cases_match_tests=F.col("d") != 0)


def recommendation_style(summaries: DataFrame) -> DataFrame:
    """Two to four recommendations, each under twenty words."""
    items = F.col("recommendations")
    words = F.transform(items, lambda r: F.size(F.split(F.trim(r), r"\s+", -1)))
    counted = summaries.select(
        "run",
        F.size(items).alias("_n"),
        F.filter(words, lambda n: n >= MAX_WORDS).alias("_long"),
    )
    number = _violations(
        counted, recommendation_count=~F.col("_n").between(MIN_RECOMMENDATIONS, MAX_RECOMMENDATIONS)
    )
    length = counted.select("run", F.explode("_long").alias("n")).select(
        F.lit("recommendation_length").alias("rule"), "run"
    )
    return number.unionByName(length)


def case_tags(cases: DataFrame) -> DataFrame:
    """The tag in a case's name is its issue id; an untagged case has none."""
    return _violations(cases, tag_is_issue=~issue_tag("name").eqNullSafe(F.col("issue_id")))


# --- all rules in one pass ------------------------------------------------------

# What a fact counts for its key: issues, urgent ones, fixes, tagged cases, and declared less found titles.
KEY_COUNTS = ("issue", "urgent", "fix", "case", "title")
# Rules a single row breaks.
ROW_RULES = ("ids_in_order", "line_exists", "recommendation_count", "recommendation_length", "tag_is_issue")
# What a fact says of its run alone.
RUN_COUNTS = ("raised", "unproven")
_FACTS = (*KEY_COUNTS, *ROW_RULES, *RUN_COUNTS)


def issue_key(issue_id) -> Column:
    return F.concat(F.lit("#"), issue_id)


def title_key(name) -> Column:
    return F.concat(F.lit("="), name)


def is_urgent(severity) -> Column:
    return F.col(severity).isin("High", "Medium")


def line_is_off(line, lines) -> Column:
    """A line number that is none of so many lines; unknown ones are not judged."""
    return ~F.col(line).between(1, F.col(lines))


def fact(run, key=None, **counts) -> Column:
    """One fact as a struct: its run, its key (none where only its run counts) and what it counts; conditions count 1."""
    key = F.lit(None).cast("string") if key is None else key
    values = [F.coalesce(F.lit(0) if n not in counts else counts[n].cast("int"), F.lit(0)).alias(n) for n in _FACTS]
    return F.struct(F.col(run).alias("run"), key.alias("key"), *values)


def advice_fact(run: str, recommendations: str) -> Column:
    """Two to four recommendations, each under twenty words."""
    items = F.col(recommendations)
    words = F.transform(items, lambda r: F.size(F.split(F.trim(r), r"\s+", -1)))
    return fact(
        run,
        recommendation_count=~F.size(items).between(MIN_RECOMMENDATIONS, MAX_RECOMMENDATIONS),
        recommendation_length=F.size(F.filter(words, lambda n: n >= MAX_WORDS)),
    )


def facts(df: DataFrame, *structs: Column) -> DataFrame:
    """The facts a row states, as rows."""
    return df.select(F.inline(F.array(*structs)))


def all_facts(
    issues: DataFrame, originals: DataFrame, analyses: DataFrame, fixes: DataFrame, cases: DataFrame, found: DataFrame,
    verification: DataFrame, summaries: DataFrame,
) -> DataFrame:
    """The facts of tables as the rules above take them.  Rows that state several facts are better tagged at once."""
    expected = F.concat(F.lit("E"), (F.col("pos") + 1).cast("string"))
    lengths = originals.select("run", F.size(split_lines("code")).alias("_n"))
    placed = issues.join(lengths, "run", "left")
    proven = (F.col("fixed_failed") == 0) & (F.col("original_failed") > 0)
    parts = [
        facts(placed, fact("run", issue_key("issue_id"), issue=F.lit(1), urgent=is_urgent("severity"),
                           ids_in_order=F.col("issue_id") != expected, line_exists=line_is_off("line", "_n"))),
        facts(fixes, fact("run", issue_key("issue_id"), fix=F.lit(1))),
        facts(cases, fact("run", issue_key("issue_id"), case=F.col("issue_id").isNotNull()),
              fact("run", title_key("name"), title=F.lit(1), tag_is_issue=~issue_tag("name").eqNullSafe(F.col("issue_id")))),
        facts(found, fact("run", title_key("name"), title=F.lit(-1))),
        facts(analyses, fact("run", raised=F.col("risk_level") != "Low")),
        facts(verification, fact("run", unproven=~F.coalesce(proven, F.lit(False)))),
        facts(summaries, advice_fact("run", "recommendations")),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_facts(rows: DataFrame, sums: dict[str, Column] | None = None, **run_rules: Column) -> DataFrame:
    """Violations per rule and run, from facts, in two aggregations: per (run, key), then per run.

    Both are summed before they are shuffled, so a run or a key with very many facts costs no more than others.  Columns
    beside those of ``fact`` are summed up to the run as ``sums`` says, and ``run_rules`` judge a run by all its sums.
    """
    sums = sums or {}
    total = [F.sum(n).alias(n) for n in (*_FACTS, *sums)]
    linked = rows.withColumns(sums).groupBy("run", "key").agg(*total)
    i, u, f, c, t = (F.col(n) for n in KEY_COUNTS)
    keyed = F.col("key").isNotNull()
    links = {
        "urgent_is_fixed": (u > 0) & (f == 0),
        "one_fix_per_issue": f > 1,
        "fix_of_known_issue": (f > 0) & (i == 0),
        "fixed_is_tested": (i > 0) & (f > 0) & (c == 0),
        "cases_match_tests": t != 0,
    }
    per_run = linked.groupBy("run").agg(
        *[F.count_if(keyed & broken).alias(rule) for rule, broken in links.items()],
        *[F.sum(n).alias(n) for n in (*_FACTS, *sums)],
    )
    judged = {
        **{rule: F.col(rule) for rule in (*links, *ROW_RULES)},
        "clean_is_low": F.when((F.col("raised") > 0) & (F.col("issue") == 0), 1).otherwise(0),
        "tests_prove_fix": F.col("unproven"),
        **{rule: broken.cast("int") for rule, broken in run_rules.items()},
    }
    found = F.array(*[F.struct(F.lit(rule).alias("rule"), n.cast("bigint").alias("violations")) for rule, n in judged.items()])
    return per_run.select("run", F.inline(found)).filter("violations > 0").select("rule", "run", "violations")


def contract_audit(*violations: DataFrame) -> DataFrame:
    """Violations per rule and run."""
    rows = reduce(DataFrame.unionByName, violations)
    return rows.groupBy("rule", "run").agg(F.count("*").alias("violations"))
