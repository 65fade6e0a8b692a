"""Checks and operators as registered queries over the test tables, with their DuckDB SQL.

Corrupted views are built from expressions that both engines read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.numeric import IsolationTrees
from lodestar.functions.quantiles import Quantiles, exact_quantiles
from lodestar.functions.shared import run_dir
from lodestar.functions.similarity import edit_similarity
from lodestar.functions.table import Table, canonical
from lodestar.operators import business, completeness, entity, formats, integrity, profile, statistics, synthetic
from lodestar.plans import analytics, described, score
from lodestar.plans.run import Report, run_checks
from lodestar.sources import catalog
from lodestar.sources.spec import SourceSpec
from lodestar.streaming.monitor import latency_windows, monitor_stream, volume_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-12-31 00:00:00"

#: Corrupted views: source table and expressions.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "orders_d": ("orders", ["o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority", "CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE o_orderstatus END AS status", "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS amount"]),
    "sparse_d": ("orders", ["o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS a", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS b", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS c"]),
    "customer_d": ("customer", ["c_custkey", "concat('user', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 7 = 0 THEN '@bad' ELSE '@example.com' END) AS email", "CASE WHEN c_custkey % 9 = 0 THEN '99 99 99 99 99 99 99' ELSE concat('+52 55 1234 ', CAST(1000 + c_custkey % 9000 AS STRING)) END AS phone", "CASE WHEN c_custkey % 8 = 0 THEN '123456' ELSE CAST(10000 + c_custkey % 80000 AS STRING) END AS zip", "CASE WHEN c_custkey % 6 = 0 THEN 'XXXX0000' ELSE 'GODE561231GR8' END AS rfc", "CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE lower(c_name) END AS name", "CASE WHEN c_custkey % 4 = 0 THEN concat(' ', c_mktsegment) WHEN c_custkey % 5 = 0 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END AS segment"]),
    "lineitem_d": ("lineitem", ["l_orderkey", "CASE WHEN l_orderkey % 101 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS part_id", "l_suppkey", "l_quantity"]),
    "dates_d": ("orders", ["o_orderkey", "CASE WHEN o_orderkey % 17 = 0 THEN '2024-02-30' ELSE concat('20', CAST(10 + o_orderkey % 15 AS STRING), '-0', CAST(1 + o_orderkey % 9 AS STRING), '-1', CAST(o_orderkey % 10 AS STRING)) END AS day"]),
    "priced_d": ("lineitem", ["l_orderkey", "l_extendedprice AS precio", "l_quantity AS cantidad", "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * l_quantity + 5 ELSE l_extendedprice * l_quantity END AS total"]),
    "taxed_d": ("lineitem", ["l_orderkey", "l_extendedprice AS subtotal", "CASE WHEN l_orderkey % 89 = 0 THEN l_extendedprice * 0.2e0 ELSE l_extendedprice * 0.16e0 END AS iva"]),
    "owners_d": ("orders", ["o_orderkey", "o_custkey % 500 AS zip", "CASE WHEN o_orderkey % 1009 = 0 THEN 'other' ELSE concat('city', CAST(o_custkey % 50 AS STRING)) END AS city"]),
    "people_d": ("customer", ["c_custkey AS key", "concat(CASE WHEN c_custkey % 4 = 0 THEN 'maria' WHEN c_custkey % 4 = 1 THEN 'mario' WHEN c_custkey % 4 = 2 THEN 'martin' ELSE 'pedro' END, ' ', CASE WHEN c_custkey % 5 = 0 THEN 'lopez' WHEN c_custkey % 5 = 1 THEN 'lopes' WHEN c_custkey % 5 = 2 THEN 'garcia' WHEN c_custkey % 5 = 3 THEN 'gracia' ELSE 'ruiz' END, CAST(c_custkey % 37 AS STRING)) AS nombre", "CAST(1012345000 + c_custkey * 7 % 900 AS STRING) AS cedula", "concat('19', CAST(60 + c_custkey % 40 AS STRING), '-0', CAST(1 + c_custkey % 9 AS STRING), '-1', CAST(c_custkey * 3 % 7 AS STRING)) AS fecha_nacimiento"]),
    "flags_d": ("orders", ["o_orderkey", "CASE WHEN o_orderkey % 500 = 0 THEN 'no' ELSE 'yes' END AS active", "CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS even", "CASE WHEN o_orderkey % 400 = 0 THEN 'rare' ELSE 'usual' END AS kind"]),
    "mixed_d": ("orders", ["CASE WHEN o_orderkey % 997 = 0 THEN 'n/a' WHEN o_orderkey % 991 = 0 THEN 'true' WHEN o_orderkey % 983 = 0 THEN '2024-01-02' ELSE CAST(o_custkey AS STRING) END AS v"]),
    "marks_d": ("customer", ["c_custkey", "CASE WHEN c_custkey % 19 = 0 THEN concat(c_name, chr(7)) WHEN c_custkey % 23 = 0 THEN concat(chr(160), c_name) ELSE c_name END AS label"]),
    "runs_d": ("orders", ["CAST(o_orderkey % 900 + CASE WHEN o_orderkey % 2 = 0 THEN 5000 ELSE 0 END AS BIGINT) AS folio"]),
    "reports_d": ("orders", ["o_orderkey AS report_id", "concat('p', CAST(o_custkey % 40 AS STRING)) AS project", "concat('g', CAST(o_custkey % 4 AS STRING)) AS group_name", "o_orderdate AS executed_at", "CAST(o_orderkey % 101 AS DOUBLE) AS score"]),
    "results_d": ("lineitem", ["l_orderkey AS report_id", "concat('rule', CAST(l_linenumber AS STRING)) AS rule_name", "CASE WHEN l_suppkey % 3 = 0 THEN 'error' WHEN l_suppkey % 3 = 1 THEN 'warning' ELSE 'info' END AS severity", "l_quantity > 12 AS passed", "CAST(l_partkey % 100 AS DOUBLE) AS failure_pct"]),
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS.get(name, (name, ["*"]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def view(name: str) -> str:
    """The view as a DuckDB subquery."""
    table, exprs = VIEWS[name]
    return f"(SELECT {', '.join(exprs)} FROM {table})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def frame(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Details of a finding with fixed columns."""
    names = [p.strip().split()[0] for p in schema.split(",")]
    kinds = [p.strip().split()[1] for p in schema.split(",")]
    cast = {"long": int, "double": float, "string": str, "boolean": bool}
    return spark.createDataFrame([tuple(None if r.get(n) is None else cast[k](r[n]) for n, k in zip(names, kinds, strict=True)) for r in rows], schema)


def check(spark: SparkSession, sf_dir: str, name: str, rule: str, **config: Any) -> Report:
    return run_checks(source(spark, sf_dir, name), rule, {rule: config}, as_of=AS_OF)


def summary(spark: SparkSession, report: Report) -> DataFrame:
    return frame(spark, [{"total": f.total, "failed": f.failed, "failure_pct": f.failure_pct, "passed": f.passed} for f in report.findings], "total long, failed long, failure_pct double, passed boolean")


def per_column(parts: list[tuple[str, str]], where: str | None = None) -> str:
    """UNION ALL of (column, SELECT ...) blocks, filtered."""
    body = " UNION ALL ".join(s for _, s in parts)
    return f"SELECT * FROM ({body}) u" + (f" WHERE {where}" if where else "")


# --- completeness ---------------------------------------------------------------------------

@query("q_null_profile", per_column([(c, f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {b}) AS blanks FROM {view('orders_d')} t") for c, b in (("priority", "trim(priority) = ''"), ("status", "trim(status) = ''"))], "nulls + blanks > 0"))
def q_null_profile(spark, d):
    return frame(spark, check(spark, d, "orders_d", "nullity").findings[0].details, "column string, nulls long, blanks long")


@query("q_null_overall", f"SELECT count(*) * 5 AS total, count(*) FILTER (WHERE priority IS NULL) + count(*) FILTER (WHERE trim(status) = '') AS failed, round((count(*) FILTER (WHERE priority IS NULL) + count(*) FILTER (WHERE trim(status) = '')) * 100.0e0 / (count(*) * 5), 2) AS failure_pct, true AS passed FROM {view('orders_d')} t")
def q_null_overall(spark, d):
    return summary(spark, check(spark, d, "orders_d", "nullity"))


@query("q_row_completeness", f"SELECT count(*) AS total, count(*) FILTER (WHERE p < 60) AS failed, round(avg(p), 2) AS avg_completeness, round(min(p), 2) AS min_completeness FROM (SELECT 100.0e0 * ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + 1) / 4 AS p FROM {view('sparse_d')} t) s")
def q_row_completeness(spark, d):
    return frame(spark, check(spark, d, "sparse_d", "row_completeness", min_completeness_pct=60).findings[0].details, "total long, failed long, avg_completeness double, min_completeness double")


@query("q_dup_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_dup_groups(spark, d):
    return completeness.duplicate_groups(source(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q_dup_text", "SELECT (SELECT count(*) FROM documents) AS total, CAST(coalesce(sum(n), 0) AS BIGINT) AS failed, count(*) AS \"groups\" FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) g")
def q_dup_text(spark, d):
    f = check(spark, d, "documents", "duplicates", columns=["text"]).findings[0]
    return frame(spark, [{"total": f.total, "failed": f.failed, "groups": f.details[0]["groups"]}], "total long, failed long, groups long")


@query("q_dup_members", "SELECT CAST(doc_id AS VARCHAR) AS row_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def q_dup_members(spark, d):
    f = run_checks(source(spark, d, "documents"), "duplicates", {"duplicates": {"columns": ["text"]}}, key="doc_id").findings[0]
    return f.failures.select("row_id")


@query("q_type_check", f"SELECT * FROM (SELECT 'zip' AS \"column\", CASE WHEN count(try_cast(zip AS DOUBLE)) = count(zip) THEN 'numeric' WHEN count(try_cast(zip AS TIMESTAMP)) = count(zip) THEN 'datetime' ELSE 'text' END AS inferred, 'text' AS expected FROM {view('customer_d')} t) x WHERE inferred <> expected")
def q_type_check(spark, d):
    f = check(spark, d, "customer_d", "types", expected_types={"zip": "text"}).findings[0]
    return frame(spark, [x for x in f.details if x["issue"] == "type"], "column string, inferred string, expected string")


@query("q_type_mixed", f"SELECT 'v' AS \"column\", string_agg(DISTINCT k, ',' ORDER BY k) AS classes FROM (SELECT CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'numeric' WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN try_cast(v AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'text' END AS k FROM {view('mixed_d')} t) x HAVING count(DISTINCT k) > 1")
def q_type_mixed(spark, d):
    """What kinds of values all rows of a column hold."""
    f = check(spark, d, "mixed_d", "types").findings[0]
    return frame(spark, [{"column": x["column"], "classes": ",".join(x["classes"])} for x in f.details if x["issue"] == "mixed"], "column string, classes string")


def _ranges_sql(table: str, column: str) -> str:
    return f"""WITH t AS (SELECT {column} AS x FROM {table}), s AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_samp(x) AS sd FROM t),
    k AS (SELECT x, (x < q1 - 1.5e0 * (q3 - q1) OR x > q3 + 1.5e0 * (q3 - q1)) AS i, abs(x - m) / sd > 3 AS z FROM t, s WHERE x IS NOT NULL)
    SELECT round(min(q1), 4) AS q1, round(min(q3), 4) AS q3, count(*) FILTER (WHERE i) AS iqr_outliers, count(*) FILTER (WHERE z) AS z_outliers, count(*) FILTER (WHERE i OR z) AS outlier_rows, count(DISTINCT CASE WHEN i OR z THEN x END) AS distinct_outlier_values FROM k, s"""


_RANGES = "q1 double, q3 double, iqr_outliers long, z_outliers long, outlier_rows long, distinct_outlier_values long"


@query("q_outliers_events", _ranges_sql("events", "value"))
def q_outliers_events(spark, d):
    f = run_checks(source(spark, d, "events").select("value"), "ranges").findings[0]
    return frame(spark, f.details, _RANGES)


@query("q_outliers_orders", _ranges_sql(view("orders_d") + " t", "amount"))
def q_outliers_orders(spark, d):
    f = run_checks(source(spark, d, "orders_d").select("amount"), "ranges").findings[0]
    return frame(spark, f.details, _RANGES)


@query("q_outlier_rows", "WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd FROM events) SELECT CAST(event_id AS VARCHAR) AS row_id FROM events, s WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1) OR abs(value - m) / sd > 3")
def q_outlier_rows(spark, d):
    df = source(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "value")
    return run_checks(df, "ranges", key="event_id").findings[0].failures.select("row_id")


def _omnibus_sql(table: str, columns: list[str]) -> str:
    m = "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(count({c}) AS DOUBLE) AS k, avg({c}::DOUBLE) AS a FROM {table}" for c in columns) + ")"
    x = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    return f"""{m}, c AS (SELECT "column", n, k, avg((x - a) ^ 3) / avg((x - a) ^ 2) ^ 1.5 AS g1, avg((x - a) ^ 4) / avg((x - a) ^ 2) ^ 2 - 3 AS g2 FROM m JOIN ({x}) v USING ("column") GROUP BY 1, 2, 3),
    b AS (SELECT *, g1 * sqrt((k + 1) * (k + 3) / (6 * (k - 2))) AS y, sqrt(2 * (3 * (k * k + 27 * k - 70) * (k + 1) * (k + 3) / ((k - 2) * (k + 5) * (k + 7) * (k + 9)) - 1)) - 1 AS w,
      (g2 + 3 - 3 * (k - 1) / (k + 1)) / sqrt(24 * k * (k - 2) * (k - 3) / ((k + 1) ^ 2 * (k + 3) * (k + 5))) AS x, 6 * (k * k - 5 * k + 2) / ((k + 7) * (k + 9)) * sqrt(6 * (k + 3) * (k + 5) / (k * (k - 2) * (k - 3))) AS r FROM c),
    d AS (SELECT *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS f FROM b),
    z AS (SELECT *, asinh(y * sqrt((w - 1) / 2)) / sqrt(0.5 * ln(w)) AS z1, (1 - 2 / (9 * f) - cbrt((1 - 2 / f) / (1 + x * sqrt(2 / (f - 4))))) / sqrt(2 / (9 * f)) AS z2 FROM d)
    SELECT "column", n, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis, round(z1 * z1 + z2 * z2, 3) AS k2 FROM z"""


@query("q_normality", _omnibus_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def q_normality(spark, d):
    """How far columns of any length are from normal ones, by moments."""
    df = source(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return statistics.normality(df).select("column", "n", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"), F.round("k2", 3).alias("k2"))


@query("q_quantiles", "SELECT 'l_extendedprice' AS \"column\", unnest([0.001e0, 0.01, 0.5, 0.9, 0.99, 0.999]) AS share, round(unnest(quantile_cont(l_extendedprice, [0.001, 0.01, 0.5, 0.9, 0.99, 0.999])), 4) AS value FROM lineitem UNION ALL SELECT 'l_quantity', unnest([0.25e0, 0.5]), round(unnest(quantile_cont(l_quantity::DOUBLE, [0.25, 0.5])), 4) FROM lineitem")
def q_quantiles(spark, d):
    """Exact quantiles of two columns, selected together."""
    asks = {"l_extendedprice": (0.001, 0.01, 0.5, 0.9, 0.99, 0.999), "l_quantity": (0.25, 0.5)}
    found = exact_quantiles(source(spark, d, "lineitem"), [Quantiles(F.col(c), shares) for c, shares in asks.items()])
    return frame(spark, [{"column": c, "share": s, "value": round(v, 4)} for (c, shares), values in zip(asks.items(), found, strict=True) for s, v in zip(shares, values, strict=True)], "column string, share double, value double")


@query("q_pattern_explicit", f"SELECT 'url' AS \"column\", count(*) FILTER (WHERE NOT regexp_matches(url, '{completeness.PATTERNS['url']}')) AS failed, count(url) AS total FROM pages")
def q_pattern_explicit(spark, d):
    return frame(spark, check(spark, d, "pages", "patterns", column_patterns={"url": "url"}).findings[0].details, "column string, failed long, total long")


@query("q_pattern_auto", "SELECT * FROM (SELECT 'email' AS \"column\", 'email' AS pattern, count(*) FILTER (WHERE NOT regexp_matches(email, '%s')) AS failed, count(email) AS total FROM %s t UNION ALL SELECT 'phone', 'phone', count(*) FILTER (WHERE NOT regexp_matches(phone, '%s')), count(phone) FROM %s t)" % (completeness.PATTERNS["email"], view("customer_d"), completeness.PATTERNS["phone"], view("customer_d")))
def q_pattern_auto(spark, d):
    df = source(spark, d, "customer_d").select("email", "phone")
    return frame(spark, run_checks(df, "patterns").findings[0].details, "column string, pattern string, failed long, total long")


@query("q_unique_composite", "WITH a AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey), b AS (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber), c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT 'l_orderkey' AS \"column\", CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicates FROM a UNION ALL SELECT 'l_linenumber', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM b UNION ALL SELECT 'l_orderkey+l_linenumber', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM c")
def q_unique_composite(spark, d):
    return frame(spark, check(spark, d, "lineitem", "uniqueness", key_columns=["l_orderkey", "l_linenumber"]).findings[0].details, "column string, duplicates long")


@query("q_ref_same_table", "SELECT 'n_regionkey' AS child, count(*) FILTER (WHERE n_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 1)) AS orphans, count(n_regionkey) AS total FROM nation")
def q_ref_same_table(spark, d):
    df = source(spark, d, "nation").withColumn("parent", F.when(F.col("n_nationkey") > 1, F.col("n_nationkey")))
    return frame(spark, run_checks(df, "referential", {"referential": {"references": [("n_regionkey", "parent")]}}).findings[0].details, "child string, orphans long, total long")


@query("q_cardinality", per_column([(c, f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) * 100.0e0 / count(*), 2) AS pct, CASE WHEN count(DISTINCT {c}) = 1 THEN 'SINGLE_VALUE' ELSE 'HIGH_CARDINALITY' END AS issue, {t} AS is_text FROM customer") for c, t in (("c_custkey", "false"), ("c_name", "true"), ("c_nationkey", "false"), ("c_acctbal", "false"), ("c_mktsegment", "true"))], "\"distinct\" = 1 OR (pct > 95 AND is_text)").replace("SELECT * FROM (", 'SELECT "column", "distinct", pct, issue FROM (', 1))
def q_cardinality(spark, d):
    return frame(spark, check(spark, d, "customer", "cardinality").findings[0].details, "column string, distinct long, pct double, issue string")


# --- formats --------------------------------------------------------------------------------

def _gate_sql(table: str, column: str, candidate: str, valid: str) -> str:
    return f"SELECT '{column}' AS \"column\", count(*) FILTER (WHERE {candidate}) AS candidates, count(*) FILTER (WHERE {candidate} AND {valid}) AS valid, count(*) FILTER (WHERE {candidate} AND NOT {valid}) AS failed FROM {table} t"


_GATE = "column string, candidates long, valid long, failed long"


@query("q_email", _gate_sql(view("customer_d"), "email", "contains(email, '@')", "regexp_matches(email, '%s')" % formats.EMAIL.replace("'", "''")))
def q_email(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("email", "name"), "email_valid").findings[0].details, _GATE)


@query("q_phone", _gate_sql(view("customer_d"), "phone", r"regexp_matches(phone, '[\d\s()+.-]{7,}')", "(" + " OR ".join(f"regexp_matches(trim(phone), '{p}')" for p in formats.PHONES) + ")"))
def q_phone(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("phone"), "phone_valid").findings[0].details, _GATE)


@query("q_zip", _gate_sql(view("customer_d"), "zip", r"regexp_matches(trim(zip), '\d{4,}')", "(" + " OR ".join(f"regexp_matches(trim(zip), '{p}')" for p in formats.ZIPS) + ")"))
def q_zip(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("zip"), "zip_valid").findings[0].details, _GATE)


@query("q_rfc", _gate_sql(view("customer_d"), "rfc", "length(upper(trim(rfc))) >= 10", f"(regexp_matches(upper(trim(rfc)), '{formats.RFC}') OR regexp_matches(upper(trim(rfc)), '{formats.CURP}'))"))
def q_rfc(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("rfc"), "rfc_curp").findings[0].details, _GATE)


@query("q_special_chars", f"SELECT 'label' AS \"column\", count(*) FILTER (WHERE contains(label, chr(7)) OR contains(label, chr(160))) AS rows, count(*) FILTER (WHERE contains(label, chr(7))) AS critical, count(*) FILTER (WHERE contains(label, chr(160))) AS nonstandard_space FROM {view('marks_d')} t")
def q_special_chars(spark, d):
    return frame(spark, check(spark, d, "marks_d", "special_chars").findings[0].details, "column string, rows long, critical long, nonstandard_space long")


@query("q_special_characters", f"SELECT c_custkey, 'label' AS \"column\", CAST(i AS BIGINT) AS position, CASE WHEN ch = chr(7) THEN 'U+0007' ELSE 'U+00A0' END AS code_point, CASE WHEN ch = chr(7) THEN '' ELSE 'NO-BREAK SPACE' END AS name, CASE WHEN ch = chr(7) THEN 'critical' ELSE 'nonstandard_space' END AS kind FROM (SELECT c_custkey, unnest(range(1, length(label) + 1)) AS i, substr(label, CAST(i AS INT), 1) AS ch FROM {view('marks_d')} t) x WHERE ch IN (chr(7), chr(160))")
def q_special_characters(spark, d):
    return formats.special_characters(source(spark, d, "marks_d"), key="c_custkey").withColumnRenamed("row_id", "c_custkey").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("q_string_length", "SELECT 'text' AS \"column\", count(*) FILTER (WHERE length(text) < 1 OR length(text) > 255) AS failed, count(text) AS total, min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def q_string_length(spark, d):
    return frame(spark, run_checks(source(spark, d, "documents").select("text"), "string_length").findings[0].details, "column string, failed long, total long, min_length long, max_length long")


@query("q_trim", f"SELECT 'segment' AS \"column\", count(*) FILTER (WHERE starts_with(segment, ' ') OR ends_with(segment, ' ')) AS failed, count(*) FILTER (WHERE starts_with(segment, ' ')) AS leading, count(*) FILTER (WHERE ends_with(segment, ' ')) AS trailing FROM {view('customer_d')} t")
def q_trim(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("segment"), "trim_check").findings[0].details, "column string, failed long, leading long, trailing long")


@query("q_case", f"SELECT 'name' AS \"column\", 'lower' AS norm, count(*) FILTER (WHERE NOT (name = lower(name) AND name <> upper(name))) AS failed, count(name) AS total FROM {view('customer_d')} t")
def q_case(spark, d):
    return frame(spark, run_checks(source(spark, d, "customer_d").select("name"), "case_check").findings[0].details, "column string, norm string, failed long, total long")


# --- dates ----------------------------------------------------------------------------------

@query("q_invalid_dates", f"SELECT 'day' AS \"column\", count(*) FILTER (WHERE try_cast(day AS DATE) IS NULL) AS failed, count(day) AS total FROM {view('dates_d')} t")
def q_invalid_dates(spark, d):
    return frame(spark, run_checks(source(spark, d, "dates_d").select("day"), "invalid_dates").findings[0].details, "column string, failed long, total long")


@query("q_date_range", f"SELECT 'o_orderdate' AS \"column\", count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS before_min, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2000-06-30') AS after_max, count(o_orderdate) AS total FROM orders")
def q_date_range(spark, d):
    return frame(spark, check(spark, d, "orders", "date_range", min_year=1996, max_date="2000-06-30 00:00:00").findings[0].details, "column string, before_min long, after_max long, total long")


@query("q_date_pairs", "SELECT 'o_orderdate' AS \"first\", 'due' AS \"second\", count(*) FILTER (WHERE o_orderdate > due) AS failed, count(*) AS total FROM (SELECT o_orderdate, o_orderdate + CAST((o_orderkey % 10 - 6) AS INTEGER) * INTERVAL 1 DAY AS due FROM orders) t HAVING count(*) FILTER (WHERE o_orderdate > due) * 2 > count(*)")
def q_date_pairs(spark, d):
    df = source(spark, d, "orders").select("o_orderdate", (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10 - 6).cast("int"))).alias("due"))
    return frame(spark, run_checks(df, "date_inconsistency").findings[0].details, "first string, second string, failed long, total long")


@query("q_freshness", "SELECT 'o_orderdate' AS \"column\", count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2001-12-31' - INTERVAL 365 DAY) AS failed, count(o_orderdate) AS total FROM orders")
def q_freshness(spark, d):
    return frame(spark, check(spark, d, "orders", "freshness").findings[0].details, "column string, failed long, total long")


@query("q_latency", "SELECT count(*) FILTER (WHERE abs(h) > 24) AS failed, count(h) AS total, round(max(abs(h)), 2) AS max_latency_h, round(avg(abs(h)), 2) AS avg_latency_h FROM (SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS h FROM orders JOIN lineitem ON o_orderkey = l_orderkey) t")
def q_latency(spark, d):
    df = source(spark, d, "orders").join(source(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderdate", "l_shipdate")
    f = run_checks(df, "latency", {"latency": {"event_col": "o_orderdate", "ingest_col": "l_shipdate"}}).findings[0]
    return frame(spark, f.details, "failed long, total long, max_latency_h double, avg_latency_h double")


# --- business -------------------------------------------------------------------------------

@query("q_cross", f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT abs(total - precio * cantidad) < 0.01) AS failed FROM {view('priced_d')} t")
def q_cross(spark, d):
    return frame(spark, check(spark, d, "priced_d", "cross_consistency").findings[0].details, "total long, failed long")


@query("q_fd", f"SELECT zip, count(DISTINCT city) AS n_values FROM {view('owners_d')} t WHERE zip IS NOT NULL GROUP BY zip HAVING count(DISTINCT city) > 1")
def q_fd(spark, d):
    return business.dependency_violations(source(spark, d, "owners_d"), "zip", "city")


@query("q_fd_summary", f"SELECT count(*) AS total, count(*) FILTER (WHERE n > 1) AS failed FROM (SELECT count(DISTINCT city) AS n FROM {view('owners_d')} t GROUP BY zip) g")
def q_fd_summary(spark, d):
    return frame(spark, check(spark, d, "owners_d", "functional_dependency").findings[0].details, "total long, failed long")


@query("q_derived", f"SELECT 'iva' AS target, count(*) FILTER (WHERE abs((iva - subtotal * 0.16e0) / (subtotal * 0.16e0)) > 0.01e0) AS failed, count(*) FILTER (WHERE subtotal * 0.16e0 <> 0) AS total FROM {view('taxed_d')} t")
def q_derived(spark, d):
    return frame(spark, check(spark, d, "taxed_d", "derived_columns").findings[0].details, "target string, failed long, total long")


def _top_sql(table: str, columns: list[str], extra: str = "") -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v, count(*) AS k FROM {table} t WHERE {c} IS NOT NULL GROUP BY 2" for c in columns]
    return f"WITH f AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY k DESC, v) AS i, CAST(sum(k) OVER (PARTITION BY \"column\") AS BIGINT) AS n, count(*) OVER (PARTITION BY \"column\") AS n_distinct FROM f) {extra}"


@query("q_class_balance", _top_sql(view("flags_d"), ["active", "even", "kind"], "SELECT \"column\", v AS top_value, round(k * 1.0e0 / n, 4) AS share, n AS total FROM r WHERE i = 1 AND k * 1.0e0 / n >= 0.98"))
def q_class_balance(spark, d):
    return frame(spark, run_checks(source(spark, d, "flags_d").select("active", "even", "kind"), "class_balance").findings[0].details, "column string, top_value string, share double, total long")


@query("q_boolean_bias", f"SELECT 'active' AS \"column\", round(avg(CASE WHEN active = 'yes' THEN 1.0e0 ELSE 0.0e0 END), 4) AS true_share, count(*) AS total FROM {view('flags_d')} t")
def q_boolean_bias(spark, d):
    return frame(spark, run_checks(source(spark, d, "flags_d").select("active", "even", "kind"), "boolean_bias").findings[0].details, "column string, true_share double, total long")


# --- integrity ------------------------------------------------------------------------------

@query("q_missing_fks", f"SELECT 'part_id' AS \"column\", count(*) FILTER (WHERE part_id NOT IN (SELECT p_partkey FROM part)) AS orphans, count(part_id) AS total FROM {view('lineitem_d')} t")
def q_missing_fks(spark, d):
    f = check(spark, d, "lineitem_d", "missing_fks", references=[{"fk_col": "part_id", "parent": source(spark, d, "part"), "pk_col": "p_partkey"}]).findings[0]
    return frame(spark, f.details, "column string, orphans long, total long")


@query("q_orphan_rows", f"SELECT l_orderkey, part_id FROM {view('lineitem_d')} t WHERE part_id IS NOT NULL AND part_id NOT IN (SELECT p_partkey FROM part)")
def q_orphan_rows(spark, d):
    return completeness.orphans(source(spark, d, "lineitem_d"), "part_id", source(spark, d, "part"), "p_partkey").select("l_orderkey", "part_id")


@query("q_drift", "SELECT DISTINCT event_type AS value FROM events WHERE event_type NOT IN (SELECT min(event_type) FROM events)")
def q_drift(spark, d):
    events = source(spark, d, "events")
    return integrity.new_values(events, "event_type", events.agg(F.min("event_type").alias("value")))


@query("q_schema_evolution", """WITH f AS (SELECT column_name AS c, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS k FROM (DESCRIBE region)), e AS (SELECT * FROM (VALUES ('r_name', 'int'), ('r_comment', 'string')) v(c, k))
    SELECT coalesce(f.c, e.c) AS "column", CASE WHEN e.c IS NULL THEN 'added' WHEN f.c IS NULL THEN 'removed' ELSE 'type' END AS "change", e.k AS expected, f.k AS found FROM f FULL JOIN e ON f.c = e.c WHERE f.k IS DISTINCT FROM e.k""")
def q_schema_evolution(spark, d):
    f = check(spark, d, "region", "schema_evolution", reference_schema={"r_name": "int", "r_comment": "string"}).findings[0]
    return frame(spark, f.details, "column string, change string, expected string, found string")


@query("q_volume", "SELECT count(*) AS total, abs(count(*) - 10000) AS failed, round(abs(count(*) - 10000) * 100.0e0 / 10000, 2) AS failure_pct, abs(count(*) - 10000) * 100.0e0 / 10000 <= 20 AS passed FROM orders")
def q_volume(spark, d):
    return summary(spark, check(spark, d, "orders", "volume_anomaly", expected_rows=10000))


@query("q_seq_gaps", "SELECT 'l_orderkey' AS \"column\", max(l_orderkey) - min(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS gaps, min(l_orderkey) AS \"min\", max(l_orderkey) AS \"max\" FROM lineitem")
def q_seq_gaps(spark, d):
    return frame(spark, check(spark, d, "lineitem", "sequential_integrity", id_columns=["l_orderkey"]).findings[0].details, "column string, gaps long, min long, max long")


@query("q_gap_ranges", f"WITH v AS (SELECT DISTINCT folio AS v FROM {view('runs_d')} t), w AS (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM v) SELECT p + 1 AS gap_start, v - 1 AS gap_end FROM w WHERE v - p > 1")
def q_gap_ranges(spark, d):
    return integrity.gap_ranges(source(spark, d, "runs_d"), "folio")


@query("q_gap_ranges_orders", "WITH v AS (SELECT DISTINCT l_orderkey AS v FROM lineitem), w AS (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM v) SELECT p + 1 AS gap_start, v - 1 AS gap_end FROM w WHERE v - p > 1")
def q_gap_ranges_orders(spark, d):
    return integrity.gap_ranges(source(spark, d, "lineitem"), "l_orderkey")


# --- statistics -----------------------------------------------------------------------------

@query("q_moments", "SELECT 's_acctbal' AS \"column\", count(s_acctbal) AS n, round(avg(s_acctbal), 4) AS mean, round(stddev_samp(s_acctbal), 4) AS std, round(quantile_cont(s_acctbal, 0.5), 4) AS median, round(skewness(s_acctbal), 4) AS skewness, round(kurtosis(s_acctbal), 4) AS kurtosis FROM supplier")
def q_moments(spark, d):
    return profile.numeric_profile(source(spark, d, "supplier"), ["s_acctbal"]).select("column", "n", "mean", "std", "median", "skewness", "kurtosis")


@query("q_correlated_pairs", "SELECT 'l_quantity' AS a, 'double_q' AS b, round(corr(l_quantity, l_quantity * 2 + l_discount), 4) AS r FROM lineitem")
def q_correlated_pairs(spark, d):
    df = source(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 2 + F.col("l_discount")).alias("double_q"))
    f = run_checks(df, "correlations").findings[0]
    return frame(spark, [x for x in f.details if x["issue"] == "HIGH_CORRELATION"], "a string, b string, r double")


@query("q_vif", "SELECT u.\"column\", round(1 / (1 - r * r), 4) AS vif FROM (SELECT corr(l_quantity, l_quantity + 5 * l_discount * l_tax * 100) AS r FROM lineitem) s, (VALUES ('l_quantity'), ('mixed')) u(\"column\")")
def q_vif(spark, d):
    df = source(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") + 5 * F.col("l_discount") * F.col("l_tax") * 100).alias("mixed"))
    f = run_checks(df, "correlations", {"correlations": {"vif_threshold": 1}}).findings[0]
    return frame(spark, [x for x in f.details if x["issue"] == "HIGH_VIF"], "column string, vif double")


def _moments_sql(table: str, column: str) -> str:
    return f"SELECT '{column}' AS \"column\", round(skewness_pop, 4) AS skewness, round(kurtosis_pop, 4) AS kurtosis FROM (SELECT (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) * avg(x) * avg(x)) / pow(var_pop(x), 1.5) AS skewness_pop, kurtosis_pop(x) AS kurtosis_pop FROM (SELECT {column} AS x FROM {table}) e) s"


@query("q_distribution", _moments_sql("supplier", "s_acctbal"))
def q_distribution(spark, d):
    """Few enough rows to be tested for normality; at this threshold any p fails."""
    return frame(spark, run_checks(source(spark, d, "supplier").select("s_acctbal"), "distributions", {"distributions": {"shapiro_threshold": 1.0}}).findings[0].details, "column string, skewness double, kurtosis double")


@query("q_distribution_all", _moments_sql("events", "value"))
def q_distribution_all(spark, d):
    """More rows than are tested for normality."""
    df = source(spark, d, "events").select("value")
    return frame(spark, run_checks(df, "distributions").findings[0].details, "column string, skewness double, kurtosis double")


@query("q_iforest")
def q_iforest(spark, d):
    """Isolation-forest scores of line items; no SQL equivalent."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return statistics.forest_scores(source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols), cols)


# --- people ---------------------------------------------------------------------------------

_LEV = "1 - levenshtein(a.v, b.v) * 1.0e0 / greatest(length(a.v), length(b.v))"
_NAMES = f"(SELECT DISTINCT nombre AS v, concat('_', left(nombre, 1)) AS k FROM {view('people_d')} t)"


def _name_links(spark, d):
    t = Table(canonical(source(spark, d, "people_d").select("nombre")))
    _, values = entity._valued(t, F.col("nombre"), entity.name_block(F.col("nombre"), None))
    return entity._linked(entity.blocked_pairs(values), edit_similarity(F.col("node_a"), F.col("node_b")), 0.88)


@query("q_name_links", f"SELECT a.v AS u, b.v AS v, round({_LEV}, 4) AS sim FROM {_NAMES} a JOIN {_NAMES} b ON a.k = b.k AND a.v < b.v WHERE {_LEV} >= 0.88 AND {_LEV} < 1")
def q_name_links(spark, d):
    return _name_links(spark, d).withColumn("sim", F.round("sim", 4))


@query("q_name_groups", f"""WITH RECURSIVE e AS (SELECT a.v AS x, b.v AS y FROM {_NAMES} a JOIN {_NAMES} b ON a.k = b.k AND a.v <> b.v WHERE {_LEV} >= 0.88),
    r(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""")
def q_name_groups(spark, d):
    from lodestar.functions.graph import components

    return components(_name_links(spark, d).select("u", "v"))


@query("q_id_links", f"WITH n AS (SELECT DISTINCT cedula AS v, left(cedula, length(cedula) - 2) AS k FROM {view('people_d')} t) SELECT a.v AS u, b.v AS v, round({_LEV}, 4) AS sim FROM n a JOIN n b ON a.k = b.k AND a.v < b.v WHERE {_LEV} >= 0.85 AND {_LEV} < 1")
def q_id_links(spark, d):
    values = source(spark, d, "people_d").select(F.col("cedula").alias("node")).distinct().withColumn("block", entity.id_block(F.col("node")))
    return entity._linked(entity.blocked_pairs(values), edit_similarity(F.col("node_a"), F.col("node_b")), 0.85).withColumn("sim", F.round("sim", 4))


@query("q_dob_links", f"WITH n AS (SELECT DISTINCT fecha_nacimiento AS v FROM {view('people_d')} t), p AS (SELECT a.v AS u, b.v AS v, CAST(b.v AS DATE) - CAST(a.v AS DATE) AS k FROM n a JOIN n b ON left(a.v, 4) = left(b.v, 4) AND a.v < b.v) SELECT u, v, round(1 - k / 6.0e0, 4) AS sim FROM p WHERE k <= 3 AND 1 - k / 6.0e0 >= 0.6")
def q_dob_links(spark, d):
    days = source(spark, d, "people_d").select(F.col("fecha_nacimiento").alias("node")).distinct()
    return entity.day_links(days, 3, 0.6).withColumn("sim", F.round("sim", 4))


@query("q_dob_rule", f"WITH n AS (SELECT DISTINCT fecha_nacimiento AS v FROM {view('people_d')} t), g AS (SELECT DISTINCT a.v FROM n a JOIN n b ON left(a.v, 4) = left(b.v, 4) AND abs(CAST(b.v AS DATE) - CAST(a.v AS DATE)) BETWEEN 1 AND 3 AND 1 - abs(CAST(b.v AS DATE) - CAST(a.v AS DATE)) / 6.0e0 >= 0.6) SELECT (SELECT count(*) FROM customer) AS total, count(*) AS failed FROM {view('people_d')} t WHERE fecha_nacimiento IN (SELECT v FROM g)")
def q_dob_rule(spark, d):
    f = check(spark, d, "people_d", "similar_dob", threshold=0.6).findings[0]
    return frame(spark, [{"total": f.total, "failed": f.failed}], "total long, failed long")


_PEOPLE = f"(SELECT DISTINCT nombre AS n, cedula AS c, fecha_nacimiento AS f, CAST(fecha_nacimiento AS DATE) AS d, concat('_', left(nombre, 1)) AS k FROM {view('people_d')} t)"
_DAY = "CASE WHEN abs(a.d - b.d) <= 3 THEN 1 - abs(a.d - b.d) / 6.0e0 ELSE 0.0e0 END"


def _indel(a: str, b: str) -> str:
    """The ratio of insertions and deletions in SQL: the longest common subsequence by bits, for texts of up to 60 letters."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    place = f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INT) + 1, 1) = ch THEN CAST(1 AS BIGINT) << i ELSE 0 END)), 0)"
    row = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda ch: CAST({place} AS BIGINT))), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"(2.0e0 * (length({a}) - bit_count({row})) / (length({a}) + length({b})))"


def _name_ratio_sql(pairs: str) -> str:
    """``pairs`` (na, nb, ...) with sn: the ratio of names of like lengths, as they are, by sorted words, and by common words."""
    both, rest = "array_to_string(list_sort(w), ' ')", lambda x: f"array_to_string(list_concat(list_sort(w), list_sort(list_filter(string_split({x}, ' '), lambda t: NOT list_contains(w, t)))), ' ')"
    return f"""(SELECT *, greatest({_indel('na', 'nb')}, {_indel('sa', 'sb')}, 0.95e0 * CASE WHEN len(w) > 0 THEN greatest({_indel('l', 'r')}, {_indel('both_', 'l')}, {_indel('both_', 'r')}) ELSE {_indel('sa', 'sb')} END) AS sn
    FROM (SELECT *, {both} AS both_, {rest('na')} AS l, {rest('nb')} AS r FROM (SELECT *, array_to_string(list_sort(string_split(na, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(nb, ' ')), ' ') AS sb, list_intersect(string_split(na, ' '), string_split(nb, ' ')) AS w FROM {pairs}) x1) x2)"""


def _people(spark, d):
    return source(spark, d, "people_d").select(F.concat_ws("|", "nombre", "cedula", "fecha_nacimiento").alias("node"), entity.name_block(F.col("nombre"), None).alias("block"), F.col("nombre").alias("name"), F.col("cedula").alias("id"), F.col("fecha_nacimiento").alias("dob")).distinct()


def _composite_links(spark, d, least: float, method: str):
    weights = {f: entity.COMPOSITE[f] for f in ("name", "id", "dob")}
    scored = entity.composite(entity.near_pairs(_people(spark, d), weights, least, method=method), weights, method)
    return scored.where((F.col("sim") >= least) & (F.col("sim") < 1)).select(F.col("name_a").alias("na"), F.col("name_b").alias("nb"), F.col("id_a").alias("ca"), F.col("id_b").alias("cb"), F.round("sim", 3).alias("sim"))


_PAIRED = f"p a JOIN p b ON a.k = b.k AND concat(a.n, '|', a.c, '|', a.f) < concat(b.n, '|', b.c, '|', b.f)"


@query("q_composite_links", f"""WITH p AS {_PEOPLE}, s AS (SELECT a.n AS na, a.c AS ca, b.n AS nb, b.c AS cb,
    1 - levenshtein(a.n, b.n) * 1.0e0 / greatest(length(a.n), length(b.n)) AS sn, 1 - levenshtein(a.c, b.c) * 1.0e0 / greatest(length(a.c), length(b.c)) AS sc, {_DAY} AS sf FROM {_PAIRED}),
    r AS (SELECT *, round((sn * 0.3e0 + sc * 0.25e0 + sf * 0.15e0) / 0.7e0, 4) AS sim FROM s)
    SELECT na, nb, ca, cb, round(sim, 3) AS sim FROM r WHERE sim >= 0.7 AND sim < 1""")
def q_composite_links(spark, d):
    return _composite_links(spark, d, 0.7, "levenshtein")


# with birth dates further apart the other fields give 0.55 / 0.7 at most
@query("q_composite_links_all", f"""WITH p AS {_PEOPLE}, c AS (SELECT a.n AS na, a.c AS ca, b.n AS nb, b.c AS cb, {_DAY} AS sf FROM {_PAIRED} WHERE abs(a.d - b.d) <= 3),
    r AS (SELECT *, round((sn * 0.3e0 + {_indel('ca', 'cb')} * 0.25e0 + sf * 0.15e0) / 0.7e0, 4) AS sim FROM {_name_ratio_sql('c')} s)
    SELECT na, nb, ca, cb, round(sim, 3) AS sim FROM r WHERE sim >= 0.8 AND sim < 1""")
def q_composite_links_all(spark, d):
    """By the ratios of the rule's default."""
    return _composite_links(spark, d, 0.8, "indel")


@query("q_undated_links", f"""WITH p AS {_PEOPLE}, s AS (SELECT a.n AS na, a.c AS ca, b.n AS nb, b.c AS cb,
    1 - levenshtein(a.n, b.n) * 1.0e0 / greatest(length(a.n), length(b.n)) AS sn, 1 - levenshtein(a.c, b.c) * 1.0e0 / greatest(length(a.c), length(b.c)) AS sc, CASE WHEN (a.d - DATE '1970-01-01') % 3 = 0 OR (b.d - DATE '1970-01-01') % 3 = 0 THEN NULL ELSE {_DAY} END AS sf FROM {_PAIRED}),
    r AS (SELECT *, round(CASE WHEN sf IS NULL THEN (sn * 0.4e0 + sc * 0.35e0) / 0.75e0 ELSE sn * 0.4e0 + sc * 0.35e0 + sf * 0.25e0 END, 4) AS sim FROM s)
    SELECT na, nb, ca, cb, round(sim, 3) AS sim FROM r WHERE sim >= 0.88 AND sim < 1""")
def q_undated_links(spark, d):
    """People of whom a third have no birth date: those meet by similar names or document numbers."""
    weights = entity.MODES["rapido"]
    dated = _people(spark, d).withColumn("dob", F.when(F.datediff(F.col("dob").cast("date"), F.lit("1970-01-01").cast("date")) % 3 != 0, F.col("dob")))
    scored = entity.composite(entity.near_pairs(dated, weights, 0.88, method="levenshtein"), weights, "levenshtein")
    return scored.where("sim >= 0.88 and sim < 1").select(F.col("name_a").alias("na"), F.col("name_b").alias("nb"), F.col("id_a").alias("ca"), F.col("id_b").alias("cb"), F.round("sim", 3).alias("sim"))


def _members(failures: DataFrame, value: str) -> DataFrame:
    return failures.groupBy(F.col("column").alias("component"), F.col("value").alias(value)).agg(F.count("*").alias("rows"))


@query("q_fuzzy_names", f"""WITH RECURSIVE n AS {_NAMES}, c AS (SELECT a.v AS na, b.v AS nb FROM n a JOIN n b ON a.k = b.k AND a.v < b.v), l AS (SELECT na, nb FROM {_name_ratio_sql('c')} s WHERE sn >= 0.88e0 AND sn < 1),
    e AS (SELECT na AS x, nb AS y FROM l UNION ALL SELECT nb, na FROM l), r(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node), g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT root AS component, nombre AS name, count(*) AS rows FROM {view('people_d')} t JOIN g ON g.node = nombre GROUP BY 1, 2""")
def q_fuzzy_names(spark, d):
    """Groups of names by the default ratios, with how many rows have each name."""
    return _members(check(spark, d, "people_d", "fuzzy_name_match").findings[0].failures, "name")


_JSON = "concat('{\"name\":\"', {0}n, '\",\"id\":\"', {0}c, '\",\"dob\":\"', {0}f, '\"}')".replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}")


@query("q_similar_people", f"""WITH RECURSIVE p AS {_PEOPLE}, c AS (SELECT {_JSON.format('a.')} AS u, {_JSON.format('b.')} AS v, a.n AS na, a.c AS ca, b.n AS nb, b.c AS cb, {_DAY} AS sf FROM p a JOIN p b ON abs(a.d - b.d) <= 3 AND (a.k = b.k OR left(a.c, length(a.c) - 1) = left(b.c, length(b.c) - 1) OR left(a.f, 4) = left(b.f, 4)) WHERE {_JSON.format('a.')} < {_JSON.format('b.')}),
    r0 AS (SELECT *, round((sn * 0.25e0 + {_indel('ca', 'cb')} * 0.2e0 + sf * 0.15e0) / 0.6e0, 4) AS sim FROM {_name_ratio_sql('c')} s), l AS (SELECT u, v FROM r0 WHERE sim >= 0.8 AND sim < 1),
    e AS (SELECT u AS x, v AS y FROM l UNION ALL SELECT v, u FROM l), r(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node), g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT root AS component, g.node AS person, count(*) AS rows FROM (SELECT nombre AS n, cedula AS c, fecha_nacimiento AS f FROM {view('people_d')} t) m JOIN g ON g.node = {_JSON.format('m.')} GROUP BY 1, 2""")
def q_similar_people(spark, d):
    """Groups of probably equal people over all fields, with how many rows hold each of them."""
    return _members(check(spark, d, "people_d", "personas_similares", mode="profundo", threshold=0.8).findings[0].failures, "person")


# --- custom rules, scores, analytics --------------------------------------------------------

@query("q_custom_sql", "SELECT count(*) AS failed FROM orders WHERE o_totalprice < 5000 OR o_orderstatus = 'P'")
def q_custom_sql(spark, d):
    return frame(spark, check(spark, d, "orders", "custom_sql", sql="SELECT * FROM data WHERE o_totalprice < 5000 OR o_orderstatus = 'P'").findings[0].details, "failed long")


@query("q_custom_expression", "SELECT count(*) AS failed FROM lineitem WHERE NOT (l_discount < 0.08 AND l_tax < 0.07)")
def q_custom_expression(spark, d):
    return frame(spark, check(spark, d, "lineitem", "custom_expression", expression="l_discount < 0.08 AND l_tax < 0.07").findings[0].details, "failed long")


_W = "CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 5 WHEN 'info' THEN 2 ELSE 5 END"


@query("q_scores", f"SELECT report_id, s AS score, CASE WHEN s >= 90 THEN 'excelente' WHEN s >= 70 THEN 'aceptable' WHEN s >= 50 THEN 'deficiente' ELSE 'critico' END AS label FROM (SELECT report_id, round(greatest(0.0e0, 100 - sum({_W} * failure_pct) / sum({_W})), 2) AS s FROM {view('results_d')} t GROUP BY report_id) x")
def q_scores(spark, d):
    return score.score_frame(source(spark, d, "results_d"), ["report_id"])


_LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY executed_at DESC, report_id DESC) AS i FROM {view('reports_d')} t) x WHERE i = 1)"


@query("q_latest_reports", f"SELECT report_id, project, group_name, score FROM {_LATEST} l")
def q_latest_reports(spark, d):
    return analytics.latest_reports(source(spark, d, "reports_d")).select("report_id", "project", "group_name", "score")


@query("q_dashboard", f"WITH l AS {_LATEST}, r AS (SELECT l.group_name, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM {view('results_d')} t JOIN l USING (report_id) GROUP BY 1) SELECT l.group_name, count(DISTINCT project) AS total_projects, round(avg(score), 2) AS avg_score, min(n) AS rules_checked, min(p) AS rules_passed, round(min(p) * 100.0e0 / min(n), 2) AS pass_rate FROM l LEFT JOIN r USING (group_name) GROUP BY 1")
def q_dashboard(spark, d):
    return analytics.dashboard(source(spark, d, "reports_d"), source(spark, d, "results_d"))


@query("q_rule_summary", f"SELECT rule_name, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) AS total, round(count(*) FILTER (WHERE passed) * 100.0e0 / count(*), 2) AS pass_rate FROM {view('results_d')} t WHERE report_id IN (SELECT report_id FROM {_LATEST} l) GROUP BY 1 ORDER BY failed DESC, rule_name LIMIT 20")
def q_rule_summary(spark, d):
    return analytics.rule_summary(source(spark, d, "reports_d"), source(spark, d, "results_d"))


@query("q_severity_counts", f"SELECT severity, count(*) AS n FROM {view('results_d')} t WHERE report_id IN (SELECT report_id FROM {_LATEST} l) GROUP BY 1")
def q_severity_counts(spark, d):
    return analytics.severity_counts(source(spark, d, "reports_d"), source(spark, d, "results_d"))


@query("q_severity_rollup", f"SELECT severity, rule_name, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS failed FROM {view('results_d')} t GROUP BY ROLLUP (severity, rule_name)")
def q_severity_rollup(spark, d):
    return analytics.severity_rollup(source(spark, d, "results_d"))


@query("q_timeline", f"SELECT project, executed_at, score, round(score - lag(score) OVER (PARTITION BY project ORDER BY executed_at, report_id), 2) AS change FROM {view('reports_d')} t")
def q_timeline(spark, d):
    return analytics.timeline(source(spark, d, "reports_d"))


# --- profiles -------------------------------------------------------------------------------

@query("q_overview", f"SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, count(*) * 5 AS cells, count(*) FILTER (WHERE priority IS NULL) AS nulls, round(count(*) FILTER (WHERE priority IS NULL) * 100.0e0 / (count(*) * 5), 2) AS null_pct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view('orders_d')} u) v) AS duplicate_rows FROM {view('orders_d')} t")
def q_overview(spark, d):
    return profile.overview(source(spark, d, "orders_d"))


@query("q_categorical_profile", _top_sql("orders", ["o_orderstatus", "o_orderpriority"], "SELECT \"column\", n, n_distinct, v AS top_value, k AS top_n, round(k * 100.0e0 / n, 2) AS top_pct FROM r WHERE i = 1"))
def q_categorical_profile(spark, d):
    return profile.categorical_profile(source(spark, d, "orders"))


@query("q_top_values", _top_sql("lineitem", ["l_suppkey", "l_linenumber", "l_returnflag"], "SELECT \"column\", v AS value, k AS n, i AS rank FROM r WHERE i <= 10"))
def q_top_values(spark, d):
    return profile.top_values(source(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag"])


@query("q_temporal_profile", "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS n, datediff('day', min(o_orderdate), max(o_orderdate)) AS range_days FROM orders")
def q_temporal_profile(spark, d):
    return profile.temporal_profile(source(spark, d, "orders")).select("column", "n", "range_days")


@query("q_date_frequency", f"""WITH d AS (SELECT DISTINCT CAST('2020-01-01' AS DATE) + CAST(3 * (o_orderkey % 200) AS INT) AS d FROM orders), g AS (SELECT d - lag(d) OVER (ORDER BY d) AS k FROM d)
    SELECT 'day' AS "column", CASE WHEN min(k) = max(k) THEN concat(CAST(min(k) AS STRING), 'd') ELSE 'irregular' END AS frequency FROM g""")
def q_date_frequency(spark, d):
    """Dates three days apart."""
    days = source(spark, d, "orders").select(F.date_add(F.lit("2020-01-01").cast("date"), (3 * (F.col("o_orderkey") % 200)).cast("int")).alias("day"))
    return profile.temporal_profile(days).select("column", "frequency")


_NONE = "CAST(NULL AS DOUBLE)"


@query("q_column_profile", per_column([(c, f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", {'min(CAST(%s AS DOUBLE))' % c if n else _NONE} AS \"min\", {'max(CAST(%s AS DOUBLE))' % c if n else _NONE} AS \"max\", {'round(avg(%s), 4)' % c if n else _NONE} AS mean, {'CAST(NULL AS BIGINT)' if n else 'max(length(%s))' % c} AS max_length FROM {view('orders_d')} t") for c, n in (("o_orderkey", 1), ("o_custkey", 1), ("priority", 0), ("status", 0), ("amount", 1))]))
def q_column_profile(spark, d):
    return profile.column_profile(source(spark, d, "orders_d")).select("column", "nulls", "non_null", "distinct", "min", "max", "mean", "max_length")


@query("q_value_counts", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def q_value_counts(spark, d):
    return completeness.value_counts(source(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("q_volume_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2")
def q_volume_windows(spark, d):
    out = volume_windows(source(spark, d, "events"), "ts", "1 hour", ["event_type"], F.round(F.avg("value"), 4).alias("mean_value"))
    return out.select("window_start", "event_type", "n", "mean_value")


@query("q_report_page", f"SELECT report_id, project, score FROM {view('reports_d')} t WHERE executed_at >= TIMESTAMP '1997-01-01' AND executed_at <= TIMESTAMP '1999-01-01' AND group_name = 'g1' ORDER BY executed_at DESC, report_id DESC LIMIT 50 OFFSET 10")
def q_report_page(spark, d):
    return analytics.report_page(source(spark, d, "reports_d"), "1997-01-01", "1999-01-01", "g1", 10, 50).select("report_id", "project", "score")


@query("q_search_failures", f"SELECT CAST(c_custkey AS VARCHAR) AS row_id, email AS value FROM {view('customer_d')} t WHERE ends_with(email, '@bad') AND contains(email, 'r14')")
def q_search_failures(spark, d):
    df = source(spark, d, "customer_d").select(F.col("c_custkey").cast("string").alias("c_custkey"), "email")
    failures = run_checks(df.where("email is not null"), "email_valid", key="c_custkey").failures()
    return analytics.search_failures(failures, "R14").select("row_id", "value")


@query("q_failure_values", f"SELECT CAST(c_custkey AS VARCHAR) AS row_id, name FROM {view('customer_d')} t WHERE NOT (name = lower(name) AND name <> upper(name))")
def q_failure_values(spark, d):
    df = source(spark, d, "customer_d").select("c_custkey", "name")
    failures = run_checks(df, "case_check", key="c_custkey").failures()
    return analytics.with_values(failures, df, "c_custkey").select("row_id", F.get_json_object("values", "$.name").alias("name"))


@query("q_latest_actions", "SELECT report_id, row_id, status FROM (SELECT l_orderkey AS report_id, CAST(l_partkey % 5 AS VARCHAR) AS row_id, CASE WHEN l_quantity < 20 THEN 'sin_accion' WHEN l_quantity < 40 THEN 'en_revision' ELSE 'solucionado' END AS status, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_extendedprice * 1000 + l_suppkey DESC) AS i FROM lineitem) x WHERE i = 1")
def q_latest_actions(spark, d):
    """Of equal times, which the SQL leaves open, the row that is stored first."""
    actions = source(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.lit("r").alias("rule_name"), (F.col("l_partkey") % 5).cast("string").alias("row_id"), F.expr("CASE WHEN l_quantity < 20 THEN 'sin_accion' WHEN l_quantity < 40 THEN 'en_revision' ELSE 'solucionado' END").alias("status"), (F.col("l_extendedprice") * 1000 + F.col("l_suppkey")).alias("changed_at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return analytics.latest_actions(actions, ["file", "place"]).select("report_id", "row_id", "status")


_POINTS = "CAST(n >= 100 AS INT) + CAST(n >= 1000 AS INT) + CAST(n > 10000 AS INT)"


@query("q_suggest_tables", f"SELECT 'customer' AS \"table\", n AS row_count, CAST(5 AS BIGINT) AS n_columns, {_POINTS} + 0.5e0 AS score, 'nombres' AS tags FROM (SELECT count(*) AS n FROM customer) x UNION ALL SELECT 'users', n, CAST(2 AS BIGINT), {_POINTS} + 3.5e0, 'personas,email,id' FROM (SELECT count(*) AS n FROM events) x")
def q_suggest_tables(spark, d):
    customer = source(spark, d, "customer")
    infos = spark.createDataFrame([("customer", customer.count(), customer.columns), ("users", source(spark, d, "events").count(), ["id", "email"])], "table string, row_count long, col_names array<string>")
    return catalog.suggest(infos)


@query("q_selected_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def q_selected_columns(spark, d):
    return SourceSpec("parquet", f"{d}/orders.parquet", columns=("o_orderkey", "o_totalprice", "gone"), strict=False).to_df(spark).where("o_totalprice > 400000")


@query("q_late_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_id % 48 > 24) AS late FROM events GROUP BY 1")
def q_late_windows(spark, d):
    events = source(spark, d, "events").withColumn("got", F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 48).cast("int")))
    return latency_windows(events, "ts", "got", "1 day").select("window_start", "n", "late")


@query("q_all_rules")
def q_all_rules(spark, d):
    """The rules of six groups over one corrupted table; timings and model scores have no SQL equivalent."""
    return run_checks(source(spark, d, "customer_d"), "grupo:basico,grupo:formato,grupo:fechas,grupo:negocio,grupo:avanzadas,grupo:integridad", as_of=AS_OF).results().drop("duration_ms")


def _failures_sql(table: str, key: str, parts: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule_name, '{c}' AS \"column\", CAST({key} AS VARCHAR) AS row_id, {c} AS value FROM {table} t WHERE {bad}" for rule, c, bad in parts)


def _none_of(column: str, patterns: list[str]) -> str:
    return "NOT (" + " OR ".join(f"regexp_matches(trim({column}), '{p}')" for p in patterns) + ")"


FORMAT_FAILURES = [
    ("case_consistency_check", "name", "NOT (name = lower(name) AND name <> upper(name))"),
    ("email_check", "email", "contains(email, '@') AND NOT regexp_matches(email, '%s')" % formats.EMAIL.replace("'", "''")),
    ("phone_check", "phone", r"regexp_matches(phone, '[\d\s()+.-]{7,}') AND " + _none_of("phone", formats.PHONES)),
    ("trim_check", "segment", "starts_with(segment, ' ') OR ends_with(segment, ' ')"),
    ("zip_code_check", "zip", r"regexp_matches(trim(zip), '\d{4,}') AND " + _none_of("zip", formats.ZIPS)),
]  # rule, column, and which rows fail


@query("q_failures", _failures_sql(view("customer_d"), "c_custkey", FORMAT_FAILURES))
def q_failures(spark, d):
    """Failing rows of the format rules."""
    return run_checks(source(spark, d, "customer_d"), "grupo:formato", key="c_custkey").failures()


@query("q_synthetic")
def q_synthetic(spark, d):
    """A given table, corrupted at random."""
    return synthetic.corrupt(source(spark, d, "orders"), nulls=0.05, duplicates=0.02, outliers=0.01, typos=0.03)


@query("q_synthetic_counts", "SELECT count(*) + CAST(floor(count(*) * 0.02e0) AS BIGINT) AS \"rows\", count(DISTINCT o_orderkey) AS keys, CAST(floor(count(*) * 0.02e0) AS BIGINT) AS repeated FROM orders")
def q_synthetic_counts(spark, d):
    """How many rows are there, and there twice, after a share of them is repeated."""
    df = synthetic.with_duplicates(source(spark, d, "orders"), 0.02)
    by_key = df.groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return by_key.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") == 2).alias("repeated"))


ODD_ORDERS = """
COLUMNS = ["o_orderkey", "o_orderpriority", "o_totalprice"]

def check(rows):
    urgent = rows["o_orderpriority"].str.startswith("1-")
    return urgent & (rows["o_totalprice"] < 150000) & (rows["o_orderkey"] % 3 == 0)
"""


@query("q_stored_python", "SELECT CAST(o_orderkey AS VARCHAR) AS row_id FROM orders WHERE starts_with(o_orderpriority, '1-') AND o_totalprice < 150000 AND o_orderkey % 3 = 0")
def q_stored_python(spark, d):
    """Rows that Python code, as it is stored with a rule, marks as failures."""
    df = source(spark, d, "orders")
    return run_checks(df, "custom_code", {"custom_code": {"code": ODD_ORDERS}}, key="o_orderkey").findings[0].failures.select("row_id")


@query("q_monitor_stream", "SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') + count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2000-06-30') AS out_of_range, count(*) FILTER (WHERE NOT o_totalprice < 200000) AS dear FROM orders GROUP BY 1")
def q_monitor_stream(spark, d):
    """The table read as a stream, each group judged by all of its rows from kept state."""
    stream = spark.readStream.schema(source(spark, d, "orders").schema).parquet(f"{d}/orders.parque*")  # a file or a folder
    last: dict[tuple, Report] = {}
    monitor = monitor_stream(stream.select("o_orderstatus", "o_orderdate", "o_totalprice"), "date_range,custom_expression", lambda reports, _: last.update(reports), f"{run_dir(spark)}/monitor-{uuid.uuid4().hex}", {"date_range": {"min_year": 1996, "max_date": "2000-06-30 00:00:00"}, "custom_expression": {"expression": "o_totalprice < 200000"}}, by=["o_orderstatus"])
    monitor.awaitTermination()
    rows = [{"o_orderstatus": k[0], "total": r.findings[1].total, "out_of_range": r.findings[0].failed, "dear": r.findings[1].failed} for k, r in last.items()]
    return frame(spark, rows, "o_orderstatus string, total long, out_of_range long, dear long")


def _texts_sql() -> str:
    parts = []
    for rule, c, bad in FORMAT_FAILURES:
        text, suggestion = (x.replace("'", "''") for x in described.TEXTS[rule])
        parts.append(f"SELECT CAST(c_custkey AS VARCHAR) AS row_id, '{rule}' AS rule_name, replace(replace('{text}', '{{column}}', '{c}'), '{{value}}', {c}) AS text, '{suggestion}' AS suggestion FROM {view('customer_d')} t WHERE {bad}")
    return " UNION ALL ".join(parts)


@query("q_failure_texts", _texts_sql())
def q_failure_texts(spark, d):
    """What is wrong with each failing value of the format rules, and what to do about it."""
    report = run_checks(source(spark, d, "customer_d"), "grupo:formato", key="c_custkey")
    return described.described(report).select("row_id", "rule_name", "text", "suggestion")


#: Two small trees over (o_totalprice, o_custkey): feature and cut of each inner node, first child, path length at leaves.
SMALL_FOREST = IsolationTrees(
    np.array([[0, 1, -1, -1, -1], [1, -1, 0, -1, -1]]),
    np.array([[150000.0, 700.0, 0, 0, 0], [300.0, 0, 250000.0, 0, 0]]),
    np.array([[1, 3, 0, 0, 0], [1, 0, 3, 0, 0]]),
    np.array([[0, 0, 4.5, 6.0, 3.0], [0, 2.5, 0, 5.0, 7.25]]),
    5.0,
)


@query("q_forest_scores", f"SELECT o_orderkey, round(pow(2.0e0, -(CASE WHEN amount >= 150000 THEN 4.5e0 WHEN o_custkey >= 700 THEN 3.0e0 ELSE 6.0e0 END + CASE WHEN o_custkey < 300 THEN 2.5e0 WHEN amount >= 250000 THEN 7.25e0 ELSE 5.0e0 END) / 2 / 5.0e0), 9) AS anomaly_score FROM {view('orders_d')} t")
def q_forest_scores(spark, d):
    """Anomaly scores of all rows by a forest that is given; paths of isolation trees are plain arithmetic."""
    scored = statistics.scored_by(source(spark, d, "orders_d"), ["amount", "o_custkey"], SMALL_FOREST)
    return scored.select("o_orderkey", F.round("anomaly_score", 9).alias("anomaly_score"))
