"""Rules of the user's own kept as rows: Python code run in the workers."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.plans import stored
from lodestar.plans.run import run_checks

ODD = """
import re
COLUMNS = ["name", "n"]

def helper(x):
    return bool(re.search("[0-9]", x))

def check(rows):
    assert list(rows.columns) == COLUMNS
    return rows["name"].map(helper, na_action="ignore") | (rows["n"] > 95)
"""


@pytest.fixture
def df(spark):
    return spark.range(100, numPartitions=3).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("x"), F.when(F.col("id") % 7 == 0, "1").otherwise("y"))).alias("name"), F.col("id").alias("n"))


def run(df, code, **more):
    return run_checks(df, "custom_code", {"custom_code": {"code": code}}, **more).findings[0]


def test_code_marks_rows(df):
    f = run(df, ODD, key="id")
    want = {k for k in range(100) if (k % 10 and k % 7 == 0) or k > 95}
    assert (f.total, f.failed, f.passed, f.errored) == (100, len(want), False, False)
    assert {int(r["row_id"]) for r in f.failures.collect()} == want
    assert f.details[0]["columns"] == "name,n"
    scan = f.failures._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in scan


@pytest.mark.parametrize(("code", "failed"), [("def check(rows):\n    return rows[rows.n < 5]", 5), ("def check(rows):\n    return None", 0), ("check = lambda rows: [None, True][:1] * len(rows)", 0), ("def check(rows):\n    return np.where(rows.n % 2 == 0, True, False)", 50), ("def check(rows):\n    return pd.isna(rows.name)", 10)])
def test_what_check_may_return(df, code, failed):
    assert (run(df, code).failed, run(df, code).passed) == (failed, failed == 0)
    assert run(df.limit(0), code).failed == 0


@pytest.mark.parametrize("code", ["def check(rows):\n    return rows.missing > 1", "def check(rows):\n    return [True]", "COLUMNS = ['gone']\ndef check(rows): pass", "x = 1", "def check(:"])
def test_faulty_code_is_an_errored_finding(df, code):
    f = run(df, code)
    assert f.errored and f.failed == 0


def test_stored_python(spark, df, tmp_path):
    path = str(tmp_path / "rules")
    stored.save_rule(spark, path, "odd names", "python", ODD, "warning", "Names with digits", "names")
    stored.save_rule(spark, path, "small", "expression", "n < 98")
    stored.save_rule(spark, path, "none", "sql", "SELECT * FROM data WHERE name IS NULL", group="names")
    report = stored.run_stored(df, path, key="id")
    found = {f.rule_name: f for f in report.findings}
    assert {n: f.failed for n, f in found.items()} == {"odd names": 16, "small": 2, "none": 10}
    assert found["odd names"].severity == "warning" and found["odd names"].description == "Names with digits"
    assert {r["rule_name"] for r in report.failures().collect()} == set(found)
    assert {f.rule_name for f in stored.run_stored(df, path, group="names").findings} == {"odd names", "none"}
    stored.save_rule(spark, path, "odd names", "python", "def check(rows): return None")
    stored.delete_rule(spark, path, "small")
    assert {f.rule_name: f.failed for f in stored.run_stored(df, path).findings} == {"odd names": 0, "none": 10}
    stored.save_rule(spark, path, "small", "expression", "n < 99")
    assert {r["name"]: r["rule_group"] for r in stored.stored_rules(spark, path).collect()} == {"odd names": "custom", "none": "names", "small": "custom"}


def test_what_cannot_work_is_not_saved(spark, tmp_path):
    path = str(tmp_path / "rules")
    for kind, text in (("python", "def check(:"), ("python", "x = 1"), ("expression", "n <"), ("sql", "SELEC 1"), ("other", "1")):
        with pytest.raises((SyntaxError, ValueError, PySparkException, Py4JJavaError)):
            stored.save_rule(spark, path, "x", kind, text)
