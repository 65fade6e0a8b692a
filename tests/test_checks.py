"""Rules over small tables with expectations worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.functions.numeric import isolation_trees, shapiro_wilk, variance_inflation
from lodestar.plans.registry import GROUPS, RULES, catalog, load, resolve
from lodestar.plans.run import run_checks

CLEAN = [(1, "Ana", 25, "ana@example.com", 40000), (2, "Bea", 32, "bea@example.com", 41000), (3, "Carla", 28, "carla@example.com", 45000), (4, "Dina", 45, "dina@example.com", 43000), (5, "Eva", 30, "eva@example.com", 42000)]
DIRTY = [(1, "Ana", 25, "ana@example.com", 40000.0), (2, "Bea", 32, "bea@example.com", 45000.0), (2, "Bea", 32, "bea@example.com", 45000.0), (4, None, 45, "not-an-email", 30000.0), (5, "Eva", 300, "eva@example.com", None), (5, "Fay", 30, "fay@example.com", 52000.0)]


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(CLEAN, "id long, name string, age long, email string, salary long")


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, "id long, name string, age long, email string, salary double")


def one(df, rule, **config):
    f = run_checks(df, rule, {rule: config}, as_of="2024-06-30 00:00:00").findings[0]
    assert not f.errored, f.details
    return f


def test_registry():
    load()
    assert len(resolve("all")) == 40 == len(resolve("todo"))
    assert [len(GROUPS[g]) for g in ("basico", "formato", "fechas", "negocio", "avanzadas", "integridad", "personas_similares")] == [10, 8, 5, 5, 4, 3, 1]
    assert [r.key for r in resolve("nullity, grupo:fechas, nullity, nothing")] == ["nullity", *GROUPS["fechas"]]
    assert [r.key for r in resolve("nivel:medio")] == ["fuzzy_id_match", "similar_dob", "fuzzy_name_match"]
    assert resolve("grupo:nothing") == [] and resolve("nivel:ninguno") == []


def test_catalog(spark):
    rows = catalog(spark).collect()
    assert len(rows) == len(RULES) and {r["rule_group"] for r in rows} >= {"basico", "personas"}


def test_clean_table_scores_well(clean):
    report = run_checks(clean, "nullity,duplicates,types")
    assert all(f.passed for f in report.findings) and report.score == 100 and report.label == "excelente"


def test_empty_rule_list_and_table(clean):
    assert run_checks(clean, "").score == 100
    report = run_checks(clean.limit(0), "grupo:basico,grupo:formato,grupo:fechas,grupo:negocio,grupo:avanzadas,grupo:integridad,personas")
    assert [f.rule_name for f in report.findings if f.errored] == []


def test_dirty_table(dirty):
    f = one(dirty, "nullity")
    assert (f.total, f.failed, f.failure_pct, f.passed) == (30, 2, 6.67, False) and f.recommendation
    assert one(dirty, "nullity", max_null_pct=10).passed
    assert sorted((r["column"]) for r in f.failures.collect()) == ["name", "salary"]
    f = one(dirty, "duplicates")
    assert (f.failed, f.failure_pct) == (2, 33.33) and f.failures.count() == 2
    f = one(dirty, "ranges")
    own = {d["column"]: d for d in f.details}
    assert (own["age"]["q1"], own["age"]["q3"], own["age"]["upper"]) == (30.5, 41.75, 58.625)
    assert (own["salary"]["lower"], own["salary"]["upper"]) == (32500.0, 52500.0) or own["salary"]["iqr_outliers"] >= 1
    assert own["age"]["outlier_rows"] == 1 and f.total == 17
    f = one(dirty, "patterns", column_patterns={"email": "email"})
    assert (f.failed, f.failure_pct) == (1, 16.67)
    f = one(dirty, "uniqueness", key_columns=["id"])
    assert (f.failed, f.total, f.failure_pct) == (8, 6, 133.33)


def test_cardinality_of_numbers(spark):
    df = spark.range(1000)
    assert one(df, "cardinality").passed
    assert not one(df, "cardinality", text_only=False).passed
    assert one(df.selectExpr("1 as x"), "cardinality").details[0]["issue"] == "SINGLE_VALUE"


def test_types(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "a"), ("2.5", "2024-02-01", "1"), (None, None, "true")], "n string, d string, m string")
    f = one(df, "types", expected_types={"n": "text", "d": "datetime"})
    assert f.failed == 1 and [d["column"] for d in f.details if d["issue"] == "type"] == ["n"]
    assert next(d for d in f.details if d["column"] == "m")["classes"] == ["bool", "numeric", "text"]


def test_blank_is_unicode(spark):
    df = spark.createDataFrame([("  ",), ("x",), ("",), (None,)], "t string")
    assert one(df, "nullity").failed == 3


def test_formats(spark):
    df = spark.createDataFrame([(f"p{i}@example.com", f"+52 55 1234 {1000 + i}", "01234", "GODE561231GR8", f"name {i}", " x" if i == 1 else "y ") for i in range(9)] + [("broken@", "99 99 99 99 99 99 99", "123456", "XXXXXXXXXX", "NAME 9", "z")], "email string, telefono string, zip string, rfc string, label string, pad string")
    assert one(df, "email_valid").failed == 1
    assert one(df.select("telefono"), "phone_valid").failed == 1
    assert one(df.select("zip"), "zip_valid").failed == 1
    assert one(df.select("rfc"), "rfc_curp").details[0]["rfc_found"] == 9
    assert one(df.select("label"), "case_check").details[0] == {"column": "label", "norm": "lower", "failed": 1, "total": 10}
    f = one(df.select("pad"), "trim_check")
    assert (f.details[0]["leading"], f.details[0]["trailing"], f.failed) == (1, 8, 9)
    f = one(df.select("label"), "string_length", min_length=7)
    assert f.failed == 10 and f.details[0]["max_length"] == 6


def test_special_characters(spark):
    df = spark.createDataFrame([("a\u0007",), ("​z",), (" ",), ("‮",), ("",), ("fine",)], "t string")
    f = one(df, "special_chars")
    assert f.failed == 5 and f.severity == "error"
    assert {k: f.details[0][k] for k in ("critical", "security", "zero_width", "private_use", "nonstandard_space")} == dict.fromkeys(("critical", "security", "zero_width", "private_use", "nonstandard_space"), 1)


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01", "01/12/2023"), ("2024-02-30", "02/12/2023"), ("1800-01-01", "13/12/2023"), ("2030-05-05", "20/01/2023")], "a string, b string")
    f = one(df, "invalid_dates")
    assert (f.failed, f.total) == (1, 8)
    f = one(df, "date_range")
    assert [(d["column"], d["before_min"], d["after_max"]) for d in f.details] == [("a", 1, 1)]
    f = one(df, "date_inconsistency")
    assert (f.details, f.failed) == ([{"first": "a", "second": "b", "failed": 2, "total": 3}], 2)
    assert one(df, "freshness").failed == 1 + 1
    late = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5)), (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1))], "event_timestamp timestamp, ingested_at timestamp")
    f = one(late, "latency")
    assert (f.failed, f.total, f.details[0]["max_latency_h"], f.details[0]["avg_latency_h"]) == (1, 2, 48.0, 26.5)
    assert one(df, "latency").passed


def test_business(spark):
    df = spark.createDataFrame([(2.0, 3, 6.0, 5.0, 0.8), (2.0, 3, 7.0, 6.0, 0.96), (1.0, 1, None, 1.0, 0.2), (2.0, 2, 4.0, 9.0, 1.44)], "precio double, cantidad int, total double, subtotal double, iva double")
    f = one(df, "cross_consistency")
    assert {d["rule"].split()[0]: d["failed"] for d in f.details} == {"total": 2, "subtotal": 2} and f.total == 8
    f = one(df, "cross_consistency", rules=[{"label": "cheap", "expr": "precio < 2"}])
    assert f.details[-1] == {"rule": "cheap", "failed": 3, "total": 4}
    f = one(df, "derived_columns", derivations=[{"target": "precio", "formula": "cantidad - 1"}])
    assert [(d["target"], d["failed"], d["total"], d["zero_expected"]) for d in f.details] == [("iva", 1, 4, 0), ("total", 2, 3, 0), ("precio", 1, 3, 1)]
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("2", None), (None, "x")], "zip string, city string")
    f = one(df, "functional_dependency")
    assert (f.total, f.failed) == (2, 1) and f.failures.count() == 2
    df = spark.createDataFrame([("si", 1, "a")] * 199 + [("no", 0, "b")], "flag string, bit int, kind string")
    assert {d["column"] for d in one(df, "class_balance").details} == {"flag", "bit", "kind"}
    assert {d["column"]: d["true_share"] for d in one(df, "boolean_bias").details} == {"flag": 0.995, "bit": 0.995}


def test_integrity(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in (1, 2, 3, 7, 8, 8, 12)], "order_id long, kind string")
    f = one(df, "sequential_integrity")
    assert (f.details[0]["gaps"], f.details[0]["examples"], f.failed, f.failure_pct) == (6, [4, 5, 6, 9, 10, 11], 1, 600.0)
    f = one(df, "missing_fks", references=[{"fk_col": "order_id", "pk_values": [1, 2, 3, 7]}])
    assert (f.failed, f.total) == (3, 7) and f.failures.count() == 3
    assert one(df, "missing_fks").passed
    f = one(df, "drift", reference_categories={"kind": ["x"]})
    assert (f.failed, f.total, f.details[0]["examples"]) == (1, 1, ["y"])
    assert (one(df, "drift", reference_categories={"kind": ["x", "y"]}).total, one(df, "drift").total) == (0, 1)
    f = one(df, "schema_evolution", reference_schema={"order_id": "int", "gone": "string"})
    assert (f.failed, f.total) == (3, 3)
    f = one(df, "volume_anomaly", expected_rows=10)
    assert (f.passed, f.failure_pct) == (False, 30.0)
    assert (one(df, "volume_anomaly", expected_rows=8).passed, one(df, "volume_anomaly", expected_rows=8).failure_pct) == (True, 12.5)
    df = spark.createDataFrame([(1, 1), (2, 9), (None, 1)], "child long, parent long")
    f = one(df, "referential", references=[("child", "parent")])
    assert (f.failed, f.total) == (1, 2)


def test_row_completeness(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, None, None), (1, 2, 3, 4)], "a int, b int, c int, d int")
    f = one(df, "row_completeness")
    assert (f.failed, f.details[0]["avg_completeness"], f.details[0]["min_completeness"]) == (1, 58.33, 25.0)
    assert f.failures.first()["value"] == "b,c,d"


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert one(df, "nullity").failed == 2


def test_statistics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    rows = [(float(a), float(2 * a + 0.01 * b), float(np.exp(2 * c))) for a, b, c in zip(x, rng.normal(size=400), rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    f = one(df, "correlations")
    assert {(d.get("a"), d.get("b")) for d in f.details if d["issue"] == "HIGH_CORRELATION"} == {("a", "b")}
    assert {d["column"] for d in f.details if d["issue"] == "HIGH_VIF"} == {"a", "b"}
    assert [d["column"] for d in one(df, "distributions").details] == ["c"]
    same = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "k double, x double")
    assert not run_checks(same, "correlations,distributions,ranges").findings[0].errored
    far = spark.createDataFrame([*rows, *[(40.0, -90.0, 4000.0)] * 5], "a double, b double, c double")
    f = one(far, "multivariate_outliers", contamination=0.05)
    assert abs(f.failed - 0.05 * 405) <= 8
    assert f.failures.where("value like '40.0,%'").count() == 5


def test_shapiro_wilk_on_a_known_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert (round(w, 5), round(p, 6)) == (0.78881, 0.006704)


def test_variance_inflation():
    assert np.allclose(variance_inflation(np.array([[1, 0.9], [0.9, 1]])), 1 / (1 - 0.81))
    assert np.isinf(variance_inflation(np.array([[1.0, 1.0], [1.0, 1.0]]))).all()


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 60), st.integers(0, 5))
def test_isolation_trees_hold_any_sample(n, seed):
    x = np.random.default_rng(seed).integers(0, 3, (n, 2)).astype(float)
    s = isolation_trees(x, trees=5, seed=seed).scores(x)
    assert ((s > 0) & (s <= 1)).all()


def test_custom_rules(dirty):
    assert one(dirty, "custom_sql", sql="SELECT * FROM data WHERE age > 100").failed == 1
    assert one(dirty, "custom_sql", sql="WITH old AS (SELECT * FROM data WHERE age > 40) SELECT * FROM old").failed == 2
    assert one(dirty, "custom_expression", expression="salary > 0").failed == 1
    assert one(dirty, "custom_python", function=lambda df: df["age"] > 100).failed == 1
    assert one(dirty, "custom_python", function=lambda df: df.where("name is null")).failures.count() == 1


def test_a_broken_rule_is_its_own_finding(clean):
    report = run_checks(clean, "nullity,custom_expression,custom_sql", {"custom_expression": {"expression": "no_such > 1"}, "custom_sql": {"sql": "SELECT * FROM nowhere"}})
    assert [f.errored for f in report.findings] == [False, True, True] and report.score == 100
    assert report.results().count() == 3


def test_aggregates_are_shared(clean, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fused", "one group")
    run_checks(clean, "nullity,string_length,trim_check,email_valid,special_chars,zip_valid,rfc_curp,row_completeness,volume_anomaly")
    jobs = len(tracker.getJobIdsForGroup("fused"))
    spark.sparkContext.setJobGroup("other", "done")
    assert jobs <= 3


def test_distributions_of_many_values(spark):
    """Skewness, tails and normality count at every size; beyond 5000 values normality is judged by moments."""
    df = spark.range(6000).selectExpr("double(id % 100) as flat", "CASE WHEN id % 50 = 0 THEN 100.0D ELSE double(id % 3) END as skewed")
    f = one(df, "distributions")
    assert [(d["column"], d["issues"], d["shapiro_p"]) for d in f.details] == [("flat", "NON_NORMAL", None), ("skewed", "NON_NORMAL,SKEWED,HEAVY_TAILS", None)]
    assert f.total == 2 and {d["test"] for d in f.details} == {"dagostino_pearson"}


def test_distinct_counts_are_not_taken_for_counts(spark):
    """Asked in one round with plain counts of the same columns."""
    df = spark.createDataFrame([(k % 50 + 1, "only" if k % 2 else None) for k in range(200)], "folio long, kind string")
    report = run_checks(df, "cardinality,sequential_integrity,invalid_dates,freshness,nullity")
    assert [(d["column"], d["distinct"], d["issue"]) for d in report.finding("cardinality_check").details] == [("kind", 1, "SINGLE_VALUE")]
    alone = {r: run_checks(df, r).findings[0] for r in ("cardinality", "sequential_integrity")}
    assert report.finding("cardinality_check").details == alone["cardinality"].details
    assert report.finding("sequential_integrity_check").details == alone["sequential_integrity"].details
