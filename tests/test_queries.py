"""Registered queries against their DuckDB SQL, and the shape of plans."""

import math
from pathlib import Path

import pytest

from lodestar import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    mine = core.QUERIES[name](spark, str(SF))
    theirs = oracle.sql(core.ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert ordered(mine.columns, mine.collect()) == ordered(theirs.columns, theirs.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    sf = str(SF)
    assert "WindowGroupLimit" in plan(core.QUERIES["q_top_values"](spark, sf))
    assert "ReadSchema: struct<value:double>" in plan(core.source(spark, sf, "events").select("value"))
    for name in ("q_dup_groups", "q_fd", "q_orphan_rows", "q_name_links", "q_dob_links", "q_dashboard", "q_gap_ranges"):
        text = plan(core.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    pushed = plan(core.QUERIES["q_selected_columns"](spark, sf))
    assert "GreaterThan(o_totalprice,400000.0)" in pushed and "struct<o_orderkey:bigint,o_totalprice:double>" in pushed


def test_latest_actions_of_equal_times(spark):
    """Of equal times the first by the place where rows are stored, in whatever order they come."""
    rows = [(i // 5, "r", "a", f"status{i}", 1.0 if i % 5 else 0.0, i) for i in reversed(range(100))]
    df = spark.createDataFrame(rows, "report_id long, rule_name string, row_id string, status string, changed_at double, place long")
    got = core.analytics.latest_actions(df, ["place"]).collect()
    assert {r["report_id"]: r["status"] for r in got} == {k: f"status{5 * k + 1}" for k in range(20)}
