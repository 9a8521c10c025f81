"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as driver
from reviewlake.plans.oracles import ORACLES
from reviewlake.plans.queries import QUERIES

SF_DIR = driver.SMALLEST
TABLES = ["lineitem", "orders", "part", "events", "documents", "pages"]
# Alignment runs its kernel in Python.
IN_PYTHON = {"side_by_side", "diff_stats"}

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = driver.queries()[name](spark, SF_DIR)
    cursor = con.execute(driver.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)


@needs_tables
def test_entry_has_a_row_per_run(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "run" and df.count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()


@needs_tables
def test_share_of_changes_adds_up(spark):
    rows = driver.queries()["side_by_side"](spark, SF_DIR)
    total = driver.queries()["diff_stats"](spark, SF_DIR).groupBy().sum("rows", "differing").first()
    assert tuple(total) == (rows.count(), rows.filter("kind = 'changed'").count())


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_scales(spark, name):
    """No pairs of everything with everything, and Python only where lines are aligned."""
    df = driver.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("MapInArrow" in plan) == (name in IN_PYTHON)
    assert "PythonUDF" not in plan
    # Scans read the columns they need, never a whole table for a few of them.
    if "FileScan" in plan and name in {"severity_counts", "detection", "to_lines", "stage_state"}:
        assert "l_extendedprice" not in plan and "n_chars" not in plan and "props" not in plan


@needs_tables
@pytest.mark.parametrize("name", ["report_card", "assemble", "headline", "flatten_report", "index_entries", "contract_audit"])
def test_few_scans(spark, name):
    """Composite queries read lineitem at most three times."""
    df = driver.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 3
    assert plan.count("Exchange hashpartitioning") <= 7


@needs_tables
@pytest.mark.parametrize("name", ["bad_fields", "validate_reports", "flatten_report", "index_entries", "contract_audit"])
def test_rows_with_much_work_are_dealt_out(spark, name):
    """A table in one file is read by one task; its rows do not stay in it."""
    df = driver.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= plan.count("RoundRobinPartitioning(4)")
    if name in {"bad_fields", "validate_reports"}:
        assert df.rdd.getNumPartitions() == 4


@needs_tables
def test_texts_of_bad_fields_stay_small_expressions(spark):
    """Each way to break a report adds to the expression and does not double it."""
    plan = driver.queries()["bad_fields"](spark, SF_DIR)._jdf.queryExecution().analyzed().toString()
    assert plan.count("replace(") < 50
