"""Rules between columns: consistency, dependencies, balance, derived values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.table import ROW_ID, Table
from lodestar.operators.completeness import value_counts
from lodestar.plans.model import Check, Distinct, finding, percent
from lodestar.plans.registry import rule
from lodestar.plans.run import condition

# Column names that go together.
BIRTH = ["fecha_nacimiento", "fecha_nac", "nacimiento", "birth_date", "birth", "birthdate"]
DEPENDENCIES = [
    ("codigo_postal", "municipio"), ("zip", "city"), ("zip_code", "city"),
    ("id_empleado", "nombre"), ("employee_id", "name"), ("id_cliente", "cliente"),
    ("sku", "producto"), ("product_code", "product_name"),
    ("id_depto", "departamento"), ("dept_id", "department_name"),
]
TRUE, FALSE = ["true", "1", "yes", "si", "s", "t"], ["false", "0", "no", "n", "f"]
VAT = 0.16


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@rule("cross_consistency", "cross_consistency_check", "Rows that break a rule between columns")
def cross_consistency(t: Table, rules: list[dict[str, str]] | None = None, **_) -> Check:
    """rules: {label, expr} with a SQL predicate; a predicate that is null counts as broken.  Totals, subtotals and ages are found by name."""
    low = t.lower()
    own: list[tuple[str, Column]] = []
    if {"total", "precio", "cantidad"} <= low.keys():
        own.append(("total = precio × cantidad", F.abs(t.c(low["total"]) - t.c(low["precio"]) * t.c(low["cantidad"])) < 0.01))
    if {"subtotal", "total"} <= low.keys():
        own.append(("subtotal ≤ total", t.c(low["subtotal"]) <= t.c(low["total"]) + 0.01))
    if "edad" in low and any(b in low for b in BIRTH[:-1]):
        own.append(("edad ≈ año_actual - año_nacimiento", F.lit(True)))
    own += [(r.get("label", r["expr"]), F.expr(r["expr"])) for r in rules or []]
    seen: dict[str, tuple[str, Column]] = {}
    for text, predicate in own:
        seen.setdefault(text.split("=")[0].strip(), (text, predicate))
    kept = list(seen.values())
    got = (yield {"rows": F.count("*")} | {f"f{i}": F.count_if(~condition(p)) for i, (_, p) in enumerate(kept)}) if kept else {"rows": 0}
    details = [{"rule": text, "failed": got[f"f{i}"], "total": got["rows"]} for i, (text, _) in enumerate(kept)]
    whole = F.to_json(F.struct(*(t.c(c) for c in t.columns)))
    failures = t.failures("cross_consistency_check", [(text, ~condition(p), whole) for text, p in kept])
    return finding(got["rows"] * len(kept), sum(d["failed"] for d in details), details, failures, "Correct the rows that break these rules")


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(determinant, n_values) of the non-null determinants with more than one non-null dependent value."""
    key = F.col(_quoted(determinant))
    return df.where(key.isNotNull()).groupBy(key.alias(determinant)).agg(F.countDistinct(F.col(_quoted(dependent))).alias("n_values")).where("n_values > 1")


@rule("functional_dependency", "functional_dependency_check", "Values that determine more than one value of another column", severity="warning")
def functional_dependency(t: Table, fd_pairs: list[tuple[str, str]] | None = None, **_) -> Check:
    low = t.lower()
    pairs = [(low[a], low[b]) for a, b in DEPENDENCIES if a in low and b in low] + [(a, b) for a, b in fd_pairs or [] if a in t.columns and b in t.columns]
    got = (yield {f"d:{a}": Distinct(t.c(a)) for a, _ in pairs}) if pairs else {}
    details, parts = [], []
    for a, b in pairs:
        bad = dependency_violations(t.df, a, b)
        details.append({"determinant": a, "dependent": b, "failed": bad.count(), "total": got[f"d:{a}"]})
        keys = bad.select(F.col(_quoted(a)).alias("_key"))
        parts.append(t.df.join(keys, t.c(a) == F.col("_key"), "left_semi").select(F.lit("functional_dependency_check").alias("rule_name"), F.lit(f"{a}->{b}").alias("column"), F.col(ROW_ID).alias("row_id"), F.concat_ws(" -> ", t.c(a).cast("string"), t.c(b).cast("string")).alias("value")))
    return finding(sum(d["total"] for d in details), sum(d["failed"] for d in details), details, reduce(DataFrame.unionByName, parts) if parts else None, "Make the dependent value unique for each determinant")


def top_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_distinct, top_value, top_n) over the non-null values; of equal counts the smallest value is on top."""
    freq = value_counts(df, columns).where("value is not null")
    best = F.max(F.struct(F.col("n"))).alias("m")
    top = freq.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), best)
    return freq.withColumnRenamed("n", "k").join(top.withColumnRenamed("column", "c"), (F.col("column") == F.col("c")) & (F.col("k") == F.col("m.n"))).groupBy("column").agg(F.first("n").alias("n"), F.first("n_distinct").alias("n_distinct"), F.min("value").alias("top_value"), F.first("k").alias("top_n"))


@rule("class_balance", "class_balance_check", "Categories of which one has nearly all rows", severity="warning")
def class_balance(t: Table, threshold: float = 0.98, **_) -> Check:
    yield {"rows": F.count("*")}
    own = [c for c in t.comparable if c in t.text or c in t.numeric]
    rows = top_shares(t.df, own).collect() if own else []
    kept = [r for r in rows if r["n"] >= 5 and (r["column"] in t.text or r["n_distinct"] <= 10)]
    details = [{"column": r["column"], "top_value": r["top_value"], "share": round(r["top_n"] / r["n"], 4), "total": r["n"]} for r in sorted(kept, key=lambda r: t.columns.index(r["column"])) if r["top_n"] / r["n"] >= threshold]
    return finding(len(kept), len(details), details, None, "Look at columns of which nearly all rows are equal")


def as_boolean(c: Column) -> Column:
    low = F.lower(c.cast("string"))
    return F.when(low.isin(TRUE), 1.0).when(low.isin(FALSE), 0.0)


@rule("boolean_bias", "boolean_bias_check", "Yes-or-no columns with nearly one answer", severity="warning")
def boolean_bias(t: Table, threshold: float = 0.99, **_) -> Check:
    got = yield {f"d:{c}": Distinct(t.c(c)) for c in t.comparable} | {f"n:{c}": F.count(as_boolean(t.c(c))) for c in t.comparable} | {f"a:{c}": F.avg(as_boolean(t.c(c))) for c in t.comparable}
    kept = [c for c in t.comparable if 1 <= got[f"d:{c}"] <= 2 and got[f"n:{c}"] >= 5]
    details = [{"column": c, "true_share": round(got[f"a:{c}"], 4), "total": got[f"n:{c}"]} for c in kept if got[f"a:{c}"] >= threshold or got[f"a:{c}"] <= 1 - threshold]
    return finding(len(kept), len(details), details, None, "Look at columns with nearly one answer")


@rule("derived_columns", "derived_column_check", "Values that differ from their formula by over 1 %")
def derived_columns(t: Table, derivations: list[dict[str, str]] | None = None, tolerance: float = 0.01, **_) -> Check:
    """derivations: {target, formula} with a SQL formula.  Ages, taxes and totals are found by name.  Rows whose expected value is 0 only count in zero_expected."""
    low = t.lower()
    own: list[tuple[str, Column]] = []
    birth = next((low[b] for b in BIRTH if b in low), None)
    if "edad" in low and birth:
        own.append((low["edad"], F.year(t.now()) - F.year(t.c(birth).cast("string").try_cast("timestamp"))))
    if {"iva", "subtotal"} <= low.keys():
        own.append((low["iva"], t.c(low["subtotal"]) * VAT))
    if {"total", "subtotal", "iva"} <= low.keys():
        own.append((low["total"], t.c(low["subtotal"]) + t.c(low["iva"])))
    own += [(d["target"], F.expr(d["formula"])) for d in derivations or [] if "formula" in d and d["target"] in t.columns]
    ask, bad = {}, []
    for i, (target, formula) in enumerate(own):
        actual, expected = t.c(target).cast("string").try_cast("double"), formula.cast("double")
        both = actual.isNotNull() & expected.isNotNull()
        off = F.abs(F.try_divide(actual - expected, expected))
        bad.append(condition(both & (expected != 0) & (off > tolerance)))
        ask |= {f"n{i}": F.count_if(both & (expected != 0)), f"f{i}": F.count_if(bad[-1]), f"m{i}": F.max(F.when(bad[-1], off)), f"z{i}": F.count_if(both & (expected == 0) & (actual != 0))}
    got = (yield ask) if ask else {}
    kept = [i for i in range(len(own)) if got[f"n{i}"] >= 2]
    details = [{"target": own[i][0], "failed": got[f"f{i}"], "total": got[f"n{i}"], "max_deviation": got[f"m{i}"] and round(got[f"m{i}"], 4), "zero_expected": got[f"z{i}"], "pct": percent(got[f"f{i}"], got[f"n{i}"])} for i in kept]
    failures = t.failures("derived_column_check", [(own[i][0], bad[i], t.c(own[i][0])) for i in kept])
    return finding(sum(d["total"] for d in details), sum(d["failed"] for d in details), details, failures, "Recompute the derived values")
