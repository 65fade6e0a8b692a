"""Registered corpus queries against their DuckDB SQL."""

from pathlib import Path

import pytest

from lodestar.llm.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    theirs = c.sql(ORACLE_SQL[name])
    mine = QUERIES[name](spark, str(SF))
    assert sorted(mine.columns) == sorted(theirs.columns)
    at = sorted(theirs.columns)
    order = lambda columns, rows: sorted((tuple(r[columns.index(c)] for c in at) for r in rows), key=str)
    assert order(mine.columns, mine.collect()) == order(theirs.columns, theirs.fetchall())
