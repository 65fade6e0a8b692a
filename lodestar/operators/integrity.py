"""Drift, schema evolution, volume, sequences, foreign keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.table import ROW_ID, Table
from lodestar.operators.completeness import orphans
from lodestar.plans.model import Check, Distinct, Finding, finding, percent
from lodestar.plans.registry import rule

# Parts of names of columns that hold running numbers.
SEQUENCES = ["id", "folio", "numero", "number", "consecutivo"]


def new_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct non-null values of a column that ``known`` (first column) doesn't have."""
    mine = df.select(F.col(f"`{column}`").cast("string").alias("value")).where("value is not null").distinct()
    return mine.join(known.select(F.col(known.columns[0]).cast("string").alias("value")), "value", "left_anti")


@rule("drift", "drift_check", "Categories that the reference doesn't know", severity="warning")
def drift(t: Table, reference_categories: dict[str, Iterable[str]] | None = None, **_) -> Check:
    """reference_categories: known values by text column; a column without a reference is only reported, and counts in total."""
    known = reference_categories or {}
    yield {"rows": F.count("*")}
    details, total, failed, parts = [], 0, 0, []
    for c in t.text:
        if c not in known:
            total += 1
            details.append({"column": c, "note": "no reference"})
            continue
        reference = known[c] if isinstance(known[c], DataFrame) else t.df.sparkSession.createDataFrame([(str(v),) for v in known[c]], "value string")
        fresh = new_values(t.df, c, reference)
        n = fresh.count()
        if n:
            total, failed = total + 1, failed + 1
            details.append({"column": c, "new": n, "examples": [r[0] for r in fresh.orderBy("value").limit(20).collect()]})
            parts.append(t.df.join(fresh.withColumnRenamed("value", "_value"), t.c(c).cast("string") == F.col("_value"), "left_semi").select(F.lit("drift_check").alias("rule_name"), F.lit(c).alias("column"), F.col(ROW_ID).alias("row_id"), t.c(c).cast("string").alias("value")))
    return finding(total, failed, details, reduce(DataFrame.unionByName, parts) if parts else None, "Add the new categories to the reference or correct them")


def schema_changes(columns: dict[str, str], reference: dict[str, str]) -> list[dict[str, str | None]]:
    out = [{"column": c, "change": "added", "expected": None, "found": k} for c, k in columns.items() if c not in reference]
    out += [{"column": c, "change": "removed", "expected": k, "found": None} for c, k in reference.items() if c not in columns]
    return out + [{"column": c, "change": "type", "expected": k, "found": columns[c]} for c, k in reference.items() if c in columns and columns[c] != k]


@rule("schema_evolution", "schema_evolution_check", "Columns that were added, removed or changed", severity="warning")
def schema_evolution(t: Table, reference_schema: dict[str, str] | None = None, **_) -> Check:
    if not reference_schema:
        return Finding(True, len(t.columns), 0, 0.0, [{"note": "no reference"}])
    yield from ()
    kinds = dict(t.df.dtypes)
    changes = schema_changes({c: kinds[c] for c in t.columns}, reference_schema)
    added = sum(c["change"] == "added" for c in changes)
    return finding(len(reference_schema) + added, len(changes), changes, None, "Adapt the reference or the source")


@rule("volume_anomaly", "volume_anomaly_check", "An unexpected number of rows", severity="warning")
def volume_anomaly(t: Table, expected_rows: int | None = None, tolerance_pct: float = 20, **_) -> Check:
    got = yield {"rows": F.count("*")}
    n = got["rows"]
    if not expected_rows:
        return Finding(True, n, 0, 0.0, [{"actual": n, "note": "no expectation"}])
    off = round(abs(n - expected_rows) / expected_rows * 100, 2)
    passed = off <= tolerance_pct
    return finding(n, 0 if passed else abs(n - expected_rows), [{"actual": n, "expected": expected_rows, "deviation_pct": off}], None, "Look for rows that are missing or loaded twice", passed=passed, failure_pct=off)


def gap_ranges(df: DataFrame, column: str, ranges: int = 1024) -> DataFrame:
    """(gap_start, gap_end) of the runs of missing integers between the least and the greatest value.

    Values are dealt out by range, so that neighbours are found inside a bucket and only
    the edges of buckets meet in one place.
    """
    value = F.col(f"`{column}`").cast("long")
    distinct = df.where(value.isNotNull()).select(value.alias("v")).distinct()
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "gap_start long, gap_end long")
    width = max(1, (high - low) // ranges + 1)
    dealt = distinct.withColumn("bucket", F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
    inside = dealt.withColumn("before", F.lag("v").over(Window.partitionBy("bucket").orderBy("v"))).where("v - before > 1").select((F.col("before") + 1).alias("gap_start"), (F.col("v") - 1).alias("gap_end"))
    edges = dealt.groupBy("bucket").agg(F.min("v").alias("first"), F.max("v").alias("last"))  # at most `ranges` + 1 rows
    between = edges.withColumn("before", F.lag("last").over(Window.orderBy("bucket"))).where("first - before > 1").select((F.col("before") + 1).alias("gap_start"), (F.col("first") - 1).alias("gap_end"))
    return inside.unionByName(between)


@rule("sequential_integrity", "sequential_integrity_check", "Gaps in running numbers")
def sequential_integrity(t: Table, id_columns: list[str] | None = None, examples: int = 20, **_) -> Check:
    own = t.named(id_columns or []) or [c for c in t.numeric if any(k in c.lower() for k in SEQUENCES)]
    x = {c: t.c(c).cast("string").try_cast("double").try_cast("long") for c in own}
    got = (yield {k: v for c in own for k, v in ((f"n:{c}", F.count(x[c])), (f"d:{c}", Distinct(x[c])), (f"lo:{c}", F.min(x[c])), (f"hi:{c}", F.max(x[c])))}) if own else {}
    details, failed, kept = [], 0, 0
    for c in own:
        if got[f"n:{c}"] < 5:
            continue
        kept += 1
        gaps = got[f"hi:{c}"] - got[f"lo:{c}"] + 1 - got[f"d:{c}"]
        if gaps:
            runs = gap_ranges(t.df.select(x[c].alias(c)), c).orderBy("gap_start").limit(examples)
            missing = runs.select(F.explode(F.sequence("gap_start", F.least("gap_end", F.col("gap_start") + examples))).alias("v")).orderBy("v").limit(examples)
            details.append({"column": c, "gaps": gaps, "min": got[f"lo:{c}"], "max": got[f"hi:{c}"], "examples": [r[0] for r in missing.collect()]})
        failed += gaps
    return finding(kept, min(failed, 1), details, None, "Look for missing records", passed=failed == 0, failure_pct=percent(failed, kept))


@rule("missing_fks", "missing_fk_check", "Foreign keys without their parent")
def missing_fks(t: Table, references: list[dict] | None = None, **_) -> Check:
    """references: {fk_col, parent (a DataFrame), pk_col} or {fk_col, pk_values}; without any, columns named *_id are only counted."""
    own = [r for r in references or [] if r["fk_col"] in t.columns] or [{"fk_col": c} for c in t.columns if c.lower().endswith("_id") and not references]
    got = (yield {f"v:{r['fk_col']}": F.count(t.c(r["fk_col"])) for r in own}) if own else {}
    details, parts = [], []
    for r in own:
        c, lost = r["fk_col"], 0
        parent = r.get("parent")
        if parent is None and r.get("pk_values") is not None:
            kind = dict(t.df.dtypes)[c]
            parent, r = t.df.sparkSession.createDataFrame([(v,) for v in r["pk_values"]], f"pk {kind}"), r | {"pk_col": "pk"}
        if parent is not None:
            rows = orphans(t.df, c, parent, r.get("pk_col", parent.columns[0]))
            lost = rows.count()
            parts.append(rows.select(F.lit("missing_fk_check").alias("rule_name"), F.lit(c).alias("column"), F.col(ROW_ID).alias("row_id"), t.c(c).cast("string").alias("value")))
        details.append({"column": c, "orphans": lost, "total": got[f"v:{c}"]})
    return finding(sum(d["total"] for d in details), sum(d["orphans"] for d in details), details, reduce(DataFrame.unionByName, parts) if parts else None, "Add the missing parents or correct the keys")
