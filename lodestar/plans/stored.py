"""Custom rules kept as a table, so that they can be run by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.table import Table, canonical
from lodestar.operators.custom import compiled
from lodestar.plans.registry import RULES, load
from lodestar.plans.run import Report, run_rules

SCHEMA = "name string, kind string, definition string, severity string, description string, rule_group string, saved_at timestamp"
#: Kinds, the rule that runs them, and where it takes the definition.
KINDS = {"sql": ("custom_sql", "sql"), "expression": ("custom_expression", "expression"), "python": ("custom_code", "code")}


def save_rule(spark: SparkSession, path: str, name: str, kind: str, definition: str, severity: str = "error", description: str = "", group: str = "custom") -> None:
    """Appends a version of a rule; the latest one of a name counts.

    What can't work on any table isn't saved: Python that doesn't compile or defines no check,
    a predicate or query that doesn't parse.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of rule: {kind}")
    if kind == "python":
        compiled(definition)
    else:
        parser = spark._jsparkSession.sessionState().sqlParser()
        (parser.parseExpression if kind == "expression" else parser.parsePlan)(definition)
    _append(spark, path, (name, kind, definition, severity, description, group))


def delete_rule(spark: SparkSession, path: str, name: str) -> None:
    """Takes a rule out of use, as a version without a kind; its history stays."""
    _append(spark, path, (name, None, None, None, None, None))


def _append(spark: SparkSession, path: str, values: tuple) -> None:
    row = spark.createDataFrame([values], SCHEMA.removesuffix(", saved_at timestamp"))
    row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def stored_rules(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """The latest version of each rule, or of those of a group."""
    latest = F.max_by(F.struct("kind", "definition", "severity", "description", "rule_group", "saved_at"), "saved_at").alias("v")
    rules = spark.read.schema(SCHEMA).parquet(path).groupBy("name").agg(latest).select("name", "v.*").where("kind is not null")
    return rules.where(F.col("rule_group") == group) if group else rules


def run_stored(df: DataFrame, path: str, names: Iterable[str] | None = None, key: str | None = None, group: str | None = None) -> Report:
    """A report of the stored rules, of those named, or of a group, over ``df``; findings bear the rules' own names, severities and descriptions.

    All rules are one run, so that what they count of the table is counted in one job.
    """
    wanted = None if names is None else set(names)
    rows = [r for r in stored_rules(df.sparkSession, path, group).orderBy("name").collect() if wanted is None or r["name"] in wanted]  # rules, not data
    load()
    asked = [(RULES[KINDS[r["kind"]][0]], {KINDS[r["kind"]][1]: r["definition"]}) for r in rows]
    report = run_rules(Table(canonical(df, key)), asked)
    for r, f in zip(rows, report.findings, strict=True):
        f.rule_name, f.severity, f.description = r["name"], r["severity"], r["description"] or f.description
        if f.failures is not None:
            f.failures = f.failures.withColumn("rule_name", F.lit(r["name"]))
    return report
