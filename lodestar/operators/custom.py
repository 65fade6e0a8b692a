"""Rules of the user's own: SQL, predicates, functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.table import ROW_ID, Table
from lodestar.plans.model import Check, finding
from lodestar.plans.registry import rule


def _as_failures(rows: DataFrame, name: str) -> DataFrame:
    key = F.col(ROW_ID) if ROW_ID in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(name).alias("rule_name"), F.lit("*").alias("column"), key.alias("row_id"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != ROW_ID))).alias("value"))


@rule("custom_sql", "custom_sql_rule", "Rows that a SQL query returns")
def custom_sql(t: Table, sql: str = "SELECT * FROM data WHERE false", view: str = "data", **_) -> Check:
    """Every row that ``sql`` returns is a failure; the rows under test are the view ``data``."""
    got = yield {"rows": F.count("*")}
    name = f"{view}_{uuid.uuid4().hex[:12]}"
    t.df.createOrReplaceTempView(name)
    rows = t.df.sparkSession.sql(f"WITH `{view}` AS (SELECT * FROM {name}) {sql}" if not sql.lstrip().lower().startswith("with") else f"WITH `{view}` AS (SELECT * FROM {name}), {sql.lstrip()[4:].lstrip()}")
    failed = rows.count()
    return finding(got["rows"], failed, [{"sql": sql, "failed": failed}], _as_failures(rows, "custom_sql_rule"), "See the rows that the query returns")


@rule("custom_expression", "custom_expression_rule", "Rows for which a SQL predicate isn't true")
def custom_expression(t: Table, expression: str = "true", **_) -> Check:
    bad = ~F.coalesce(F.expr(expression), F.lit(False))
    got = yield {"rows": F.count("*"), "failed": F.count_if(bad)}
    return finding(got["rows"], got["failed"], [{"expression": expression, "failed": got["failed"]}], _as_failures(t.df.where(bad), "custom_expression_rule"), "See the rows that break the rule")


@rule("custom_python", "custom_python_rule", "Rows that a function marks as failures")
def custom_python(t: Table, function: Callable[[DataFrame], DataFrame | Column] | None = None, **_) -> Check:
    """function: from the rows to a boolean Column of failures, or to the DataFrame of failing rows."""
    got = yield {"rows": F.count("*")}
    result = function(t.df) if function else F.lit(False)
    rows = t.df.where(F.coalesce(result, F.lit(False))) if isinstance(result, Column) else result
    failed = rows.count()
    return finding(got["rows"], failed, [{"failed": failed}], _as_failures(rows, "custom_python_rule"), "See the rows that the function returns")


@lru_cache(maxsize=64)
def compiled(code: str) -> dict[str, Any]:
    """What ``code`` defines: check, and the names of the columns that it reads, if it says so; once for each process."""
    own: dict[str, Any] = {"pd": pd, "np": np}
    exec(compile(code, "<stored rule>", "exec"), own)  # noqa: S102  the user's own rule, run where the user's functions run
    if not callable(own.get("check")):
        raise ValueError("the code of a rule has to define check(rows)")
    return own


def _mask(rows: pd.DataFrame, found: Any) -> np.ndarray:
    """What check returned as an array: marks of all rows, the failing rows themselves, or None for none."""
    if found is None:
        return np.zeros(len(rows), bool)
    if isinstance(found, pd.DataFrame):
        return np.asarray(rows.index.isin(found.index))
    marks = pd.Series(found, dtype=object)
    if len(marks) != len(rows):
        raise ValueError(f"check returned {len(marks)} marks for {len(rows)} rows")
    return marks.fillna(False).astype(bool).to_numpy()


def _marked(code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = compiled(code)["check"]
        for b in batches:
            rows = b.drop_columns([ROW_ID]).to_pandas()
            yield b.append_column("_failed", pa.array(_mask(rows, check(rows))))

    return run


def marked(t: Table, code: str) -> DataFrame:
    """The rows, of the columns that the rule reads, with ``_failed``; batches of rows are marked in the workers."""
    wanted = compiled(code).get("COLUMNS")
    missing = [c for c in wanted or () if c not in t.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    rows = t.df.select(ROW_ID, *(t.c(c) for c in wanted or t.columns))
    return rows.mapInArrow(_marked(code), rows.withColumn("_failed", F.lit(None).cast("boolean")).schema)


@rule("custom_code", "custom_code_rule", "Rows that Python code marks as failures")
def custom_code(t: Table, code: str = "def check(rows): return None", **_) -> Check:
    """code: Python that defines ``check(rows)``, from a pandas frame to a boolean for each row that says whether it fails, to the failing rows, or to None.

    It gets some thousand rows at a time, so a rule over rows together is one in SQL.  With
    ``COLUMNS = [...]`` only these are read and sent to Python; pd and np are there.  Nulls
    among the marks are no failures; an error in the code makes the finding an errored one.
    """
    compiled(code)
    yield {"rows": F.count("*")}
    rows = marked(t, code)
    n, failed = rows.agg(F.count("*"), F.count_if("_failed")).first()
    failures = _as_failures(rows.where("_failed").drop("_failed"), "custom_code_rule")
    return finding(n, failed, [{"failed": failed, "columns": ",".join(rows.columns[1:-1])}], failures, "See the rows that the code marks")
