"""Exact quantiles by selection, and normality by moments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import quantiles
from lodestar.functions.quantiles import Quantiles, exact_quantiles
from lodestar.operators.profile import numeric_profile
from lodestar.operators.statistics import normality
from lodestar.plans.run import run_checks

SHARES = (0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0)
r = random.Random(5)
COLUMNS = {
    "normal": [r.gauss(0, 1) for _ in range(1500)],
    "heavy": [math.exp(r.gauss(0, 40)) * r.choice([-1, 1]) for _ in range(1500)],
    "whole": [float(r.randrange(30)) for _ in range(1500)],
    "one": [7.5] * 1500,
    "ends": [r.choice([5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, 1.0, math.nextafter(1.0, 2)]) for _ in range(1500)],
    "close": [1 + k * 2.0**-52 for k in range(1499)] + [1.015],
    "nulls": [None if k % 3 else float(k) for k in range(1500)],
    "single": [3.0] + [None] * 1499,
    "none": [None] * 1500,
    "infinite": [float("inf") if k < 20 else float("-inf") if k < 30 else float(k) for k in range(1500)],
}


def expected(values, share):
    x = sorted(v for v in values if v is not None)
    place = share * (len(x) - 1)
    a, b = x[int(place)], x[min(int(place) + 1, len(x) - 1)]
    return a if a == b or place == int(place) else (int(place) + 1 - place) * a + (place - int(place)) * b


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(list(zip(*COLUMNS.values(), strict=True)), ", ".join(f"{c} double" for c in COLUMNS)).repartition(5)


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles(wide, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    got = exact_quantiles(wide, [Quantiles(F.col(c), SHARES) for c in COLUMNS])
    for (name, values), found in zip(COLUMNS.items(), got, strict=True):
        if name == "none":
            assert found is None
        else:
            assert found == [expected(values, s) for s in SHARES], name


def test_as_percentile(spark, wide):
    """The same values as Spark's own exact aggregate, which holds all distinct values in one task."""
    for c in ("normal", "whole", "nulls"):
        own = wide.agg(F.percentile(c, F.array(*map(F.lit, SHARES)))).first()[0]
        assert exact_quantiles(wide, [Quantiles(F.col(c), SHARES)])[0] == pytest.approx(own, rel=1e-12)
    whole = spark.range(10_000).select((F.col("id") * 37 % 10_007).alias("x"))
    assert exact_quantiles(whole, [Quantiles(F.col("x"), (0.1, 0.9))])[0] == pytest.approx(whole.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.9)))).first()[0])


def test_histograms_are_bounded(spark, monkeypatch):
    """However many distinct values there are, a pass returns a histogram of bounded size."""
    sizes = []
    first = quantiles._histogram
    monkeypatch.setattr(quantiles, "_histogram", lambda *a: sizes.append(sum(map(len, (out := first(*a)).values()))) or out)
    df = spark.range(300_000).select(F.rand(3).alias("a"), F.randn(4).alias("b"))
    got = exact_quantiles(df, [Quantiles(F.col("a"), (0.25, 0.75)), Quantiles(F.col("b"), (0.5,))])
    assert abs(got[0][0] - 0.25) < 0.01 and abs(got[1][0]) < 0.02
    assert len(sizes) <= 4 and max(sizes) < 5000 and exact_quantiles(df, []) == []


def test_empty_table(spark, wide):
    assert exact_quantiles(wide.limit(0), [Quantiles(F.col("normal"), (0.5,))]) == [None]
    assert numeric_profile(wide.limit(0).select("normal")).collect()[0]["q1"] is None


def test_no_global_percentile(wide):
    text = numeric_profile(wide.select("normal", "whole"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text


def test_rule_uses_selection(wide):
    x = sorted(COLUMNS["normal"])
    f = run_checks(wide.select("normal"), "ranges").findings[0]
    assert f.details[0]["q1"] == round(expected(x, 0.25), 4) and f.details[0]["q3"] == round(expected(x, 0.75), 4)


def test_normality_beyond_the_ordered_test(spark):
    n = 40_000
    df = spark.range(n).select(F.randn(1).alias("normal"), F.rand(2).alias("flat"), F.exp(F.randn(3)).alias("skewed"), F.lit(1.0).alias("same")).persist()
    got = {row["column"]: row for row in normality(df).collect()}
    assert got["normal"]["p"] > 0.001 and got["flat"]["p"] < 1e-9 and got["skewed"]["p"] < 1e-9 and got["same"]["p"] is None
    report = run_checks(df.select("normal", "flat"), "distributions").findings[0]
    assert [(d["column"], d["test"], d["issues"]) for d in report.details if d["column"] == "flat"] == [("flat", "dagostino_pearson", "NON_NORMAL")]
    short = run_checks(df.select("flat").limit(400), "distributions").findings[0]
    assert short.details[0]["test"] == "shapiro_wilk" and short.details[0]["shapiro_p"] < 0.05
    assert normality(df.select("normal").limit(19)).first()["k2"] is None
    df.unpersist()


def test_omnibus_on_a_worked_example(spark):
    """Moments of a small sample put in by hand, step by step as the test is published."""
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236, 171, 169, 150, 158, 163, 149, 177, 164, 181, 155], float)
    n, c = len(x), x - x.mean()
    g1, b2 = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
    y = g1 * math.sqrt((n + 1) * (n + 3) / 6 / (n - 2))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / (n - 2) / (n + 5) / (n + 7) / (n + 9)
    w2 = -1 + math.sqrt(2 * (beta - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / (n + 1) ** 2 / (n + 3) / (n + 5)
    s = 6 * (n * n - 5 * n + 2) / (n + 7) / (n + 9) * math.sqrt(6 * (n + 3) * (n + 5) / n / (n - 2) / (n - 3))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    z2 = (1 - 2 / 9 / a - np.cbrt((1 - 2 / a) / (1 + (b2 - e) / math.sqrt(v) * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / 9 / a)
    got = normality(spark.createDataFrame([(float(v),) for v in x], "x double")).first()
    assert got["k2"] == pytest.approx(z1**2 + z2**2) and got["p"] == pytest.approx(math.exp(-got["k2"] / 2))
