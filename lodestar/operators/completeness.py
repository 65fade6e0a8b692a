"""Nulls, duplicates, types, patterns, uniqueness, references, cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.table import ROW_ID, Table
from lodestar.plans.model import Check, Distinct, finding, percent
from lodestar.plans.registry import rule

MAX_NULL_PCT = 5.0

# Named patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[\d\s\-\(\)]{7,20}$",
    "url": r"^https?://[^\s]+$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "rfc_mx": r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$",
    "curp_mx": r"^[A-Z]{4}\d{6}[HM][A-Z]{5}[0-9A-Z]\d$",
}


def blank(c: Column) -> Column:
    """Text of white space only; null is not blank."""
    return c.rlike(r"(?U)^\s*$")


@rule("nullity", "null_check", "Null and blank cells")
def nullity(t: Table, max_null_pct: float = MAX_NULL_PCT, **_) -> Check:
    ask = {"rows": F.count("*")}
    for c in t.columns:
        ask[f"n:{c}"] = F.count_if(t.c(c).isNull())
        if c in t.text:
            ask[f"b:{c}"] = F.count_if(blank(t.c(c)))
    got = yield ask
    details, failed = [], 0
    for c in t.columns:
        nulls, blanks = got[f"n:{c}"], got.get(f"b:{c}", 0)
        if nulls + blanks:
            details.append({"column": c, "nulls": nulls, "blanks": blanks, "pct": percent(nulls + blanks, got["rows"])})
        failed += nulls + blanks
    total = got["rows"] * len(t.columns)
    parts = [(c, t.c(c).isNull() | (blank(t.c(c)) if c in t.text else F.lit(False)), t.c(c)) for c in t.columns]
    pct = percent(failed, total)
    return finding(total, failed, details, t.failures("null_check", parts), "Fill or drop the empty cells of the columns named", passed=pct <= max_null_pct, failure_pct=pct)


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns and n of the value combinations that more than one row has; nulls are equal."""
    return df.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias("n")).where("n > 1")


@rule("duplicates", "duplicate_check", "Rows that occur more than once")
def duplicates(t: Table, columns: list[str] | None = None, **_) -> Check:
    own = t.named(columns or []) or t.comparable
    got = yield {"rows": F.count("*")}
    groups = duplicate_groups(t.df.select(*(t.c(c).cast("string").alias(c) for c in own)), own)
    row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    keyed = t.df.withColumn("_key", F.to_json(F.struct(*(t.c(c).cast("string").alias(c) for c in own))))
    again = keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1")
    failures = keyed.join(again, "_key", "left_semi").select(F.lit("duplicate_check").alias("rule_name"), F.lit(",".join(own)).alias("column"), F.col(ROW_ID).alias("row_id"), F.col("_key").alias("value"))
    return finding(got["rows"], row[0], [{"columns": own, "groups": row[1], "rows": row[0]}], failures, "Remove or merge the repeated rows")


def as_number(c: Column) -> Column:
    """The number in a text, or null; only text that begins like one is parsed, as a failed parse is dear."""
    return F.when(c.rlike(r"^\s*[+-]?(\d|\.\d|[iInN])"), c.try_cast("double"))


def as_time(c: Column) -> Column:
    """The timestamp in a text, or null."""
    return F.when(c.rlike(r"^\s*[+-]?\d{4}"), c.try_cast("timestamp"))


def value_class(c: Column) -> Column:
    """What a text looks like: numeric, bool, date or text; null for null."""
    low = F.lower(F.trim(c))
    return F.when(c.isNull(), None).when(as_number(c).isNotNull(), "numeric").when(low.isin("true", "false"), "bool").when(as_time(c).isNotNull(), "date").otherwise("text")


@rule("types", "type_check", "Columns whose values are of another type than expected")
def types(t: Table, expected_types: dict[str, str] | None = None, **_) -> Check:
    """expected_types: numeric, datetime or text by column; columns whose values are of several kinds are mentioned."""
    expected = expected_types or {}
    ask = {}
    for c in t.text:
        ask |= {f"v:{c}": F.count(t.c(c)), f"n:{c}": F.count(as_number(t.c(c))), f"d:{c}": F.count(as_time(t.c(c))), f"k:{c}": F.array_sort(F.collect_set(value_class(t.c(c))))}
    got = (yield ask) if ask else {}
    details, failed = [], 0
    mixed = {c: got[f"k:{c}"] for c in t.text}  # four kinds at most
    for c in t.columns:
        if c in t.numeric:
            found = "numeric"
        elif c in t.temporal:
            found = "datetime"
        elif c in t.text and got[f"v:{c}"] and got[f"n:{c}"] == got[f"v:{c}"]:
            found = "numeric"
        elif c in t.text and got[f"v:{c}"] and got[f"d:{c}"] == got[f"v:{c}"]:
            found = "datetime"
        else:
            found = "text"
        wrong = expected.get(c, found) != found
        several = len(mixed.get(c, [])) > 1
        failed += wrong
        if wrong or several:
            details.append({"column": c, "inferred": found, "expected": expected.get(c, found), "issue": "type" if wrong else "mixed", "classes": mixed.get(c)})
    return finding(len(t.columns), failed, details, None, "Cast the columns to their expected types")


@rule("patterns", "pattern_check", "Text that doesn't follow its column's pattern")
def patterns(t: Table, column_patterns: dict[str, str] | None = None, **_) -> Check:
    """column_patterns: a named pattern or a regular expression by column; without any, patterns that over 80 % of a column follow are found."""
    if column_patterns:
        own = {c: PATTERNS.get(p, p) for c, p in column_patterns.items() if c in t.columns}
        bad = {c: ~t.c(c).cast("string").rlike(p if p.startswith("^") else f"^(?:{p})") for c, p in own.items()}
        got = yield {k: v for c in own for k, v in ((f"v:{c}", F.count(t.c(c))), (f"f:{c}", F.count_if(bad[c])))}
        details = [{"column": c, "pattern": column_patterns[c], "failed": got[f"f:{c}"], "total": got[f"v:{c}"]} for c in own]
        failures = t.failures("pattern_check", [(c, b, t.c(c)) for c, b in bad.items()])
        return finding(sum(d["total"] for d in details) or len(t.columns), sum(d["failed"] for d in details), details, failures, "Correct the values that don't match")
    ask = {f"v:{c}": F.count(t.c(c)) for c in t.text} | {f"{k}:{c}": F.count_if(t.c(c).rlike(p)) for c in t.text for k, p in PATTERNS.items()}
    got = (yield ask) if ask else {}
    details = []
    for c in t.text:
        n = got[f"v:{c}"]
        name = next((k for k in PATTERNS if n >= 3 and got[f"{k}:{c}"] > 0.8 * n), None)
        if name:
            details.append({"column": c, "pattern": name, "failed": n - got[f"{name}:{c}"], "total": n})
    failures = t.failures("pattern_check", [(d["column"], ~t.c(d["column"]).rlike(PATTERNS[d["pattern"]]), t.c(d["column"])) for d in details])
    return finding(sum(d["total"] for d in details) or len(t.columns), sum(d["failed"] for d in details), details, failures, "Correct the values that don't match")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, in one shuffle; nulls count as a value."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    return df.select(cells.alias("cell")).groupBy("cell.column", "cell.value").agg(F.count("*").alias("n"))


@rule("uniqueness", "unique_check", "Values of key columns that occur more than once")
def uniqueness(t: Table, key_columns: list[str] | None = None, **_) -> Check:
    own = t.named(key_columns or []) or t.comparable[:3]
    got = yield {"rows": F.count("*")}
    freq = value_counts(t.df, own)
    again = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    rows = {r["column"]: r for r in freq.groupBy("column").agg(F.sum(again).alias("dup"), F.count("value").alias("uniq")).collect()}
    details = [{"column": c, "duplicates": rows[c]["dup"] if c in rows else 0, "unique_values": rows[c]["uniq"] if c in rows else 0} for c in own]
    failed = sum(d["duplicates"] for d in details)
    if key_columns and own:
        both = duplicate_groups(t.df, own).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        details.append({"column": "+".join(own), "duplicates": both, "composite": True})
        failed += both
    parts = []
    for c in own:
        again = t.df.groupBy(t.c(c).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
        rows = t.df.join(again, t.c(c).eqNullSafe(F.col("_key")), "left_semi")
        parts.append(rows.select(F.lit("unique_check").alias("rule_name"), F.lit(c).alias("column"), F.col(ROW_ID).alias("row_id"), t.c(c).cast("string").alias("value")))
    return finding(got["rows"] * len(own), failed, details, reduce(DataFrame.unionByName, parts) if parts else None, "Make the key columns unique")


def orphans(children: DataFrame, child: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose non-null ``child`` value no row of ``parents`` has."""
    known = parents.select(F.col(f"`{parent}`").alias("_parent")).where(F.col("_parent").isNotNull()).distinct()
    kids = children.where(F.col(f"`{child}`").isNotNull())
    return kids.join(known, kids[f"`{child}`"] == F.col("_parent"), "left_anti")


@rule("referential", "referential_integrity_check", "Values that their parent column doesn't have")
def referential(t: Table, references: list[tuple[str, str]] | None = None, **_) -> Check:
    """references: (child column, parent column) of the same table."""
    details, parts = [], []
    own = [(a, b) for a, b in references or [] if a in t.columns and b in t.columns]
    got = (yield {f"v:{a}": F.count(t.c(a)) for a, _ in own}) if own else {}
    for a, b in own:
        lost = orphans(t.df, a, t.df, b)
        details.append({"child": a, "parent": b, "orphans": lost.count(), "total": got[f"v:{a}"]})
        parts.append(lost.select(F.lit("referential_integrity_check").alias("rule_name"), F.lit(a).alias("column"), F.col(ROW_ID).alias("row_id"), t.c(a).cast("string").alias("value")))
    return finding(sum(d["total"] for d in details), sum(d["orphans"] for d in details), details, reduce(DataFrame.unionByName, parts) if parts else None, "Add the missing parents or correct the references")


@rule("cardinality", "cardinality_check", "Columns of one value, or text of nearly only different values")
def cardinality(t: Table, text_only: bool = True, approximate: bool = False, high_pct: float = 95.0, **_) -> Check:
    count = F.approx_count_distinct if approximate else Distinct
    got = yield {"rows": F.count("*")} | {f"d:{c}": count(t.c(c)) for c in t.comparable}
    details = []
    for c in t.comparable:
        n = got[f"d:{c}"]
        pct = percent(n, got["rows"])
        issue = "SINGLE_VALUE" if n == 1 else "HIGH_CARDINALITY" if pct > high_pct and (not text_only or c in t.text) else None
        if issue:
            details.append({"column": c, "distinct": n, "pct": pct, "issue": issue})
    return finding(len(t.columns), len(details), details, None, "Look at constant columns and at free text used as a category")
