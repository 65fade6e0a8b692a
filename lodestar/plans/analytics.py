"""Analytics over stored reports (report_id, project, group_name, executed_at, score) and their rule results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each project; of equal times the greatest report_id."""
    newest = Window.partitionBy("project").orderBy(F.desc("executed_at"), F.desc("report_id"))
    return reports.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def dashboard(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(group_name, total_projects, avg_score, rules_checked, rules_passed, pass_rate) of each group's latest reports."""
    last = latest_reports(reports)
    scores = last.groupBy("group_name").agg(F.countDistinct("project").alias("total_projects"), F.round(F.avg("score"), 2).alias("avg_score"))
    rules = results.join(last.select("report_id", "group_name"), "report_id").groupBy("group_name").agg(F.count("*").alias("rules_checked"), F.count_if("passed").alias("rules_passed"))
    return scores.join(rules, "group_name", "left").withColumn("pass_rate", F.round(F.try_divide(F.col("rules_passed") * 100.0, F.col("rules_checked")), 2))


def rule_summary(reports: DataFrame, results: DataFrame, top: int = 20) -> DataFrame:
    """(rule_name, passed, failed, total, pass_rate) over the latest reports, the most often failing ``top`` rules."""
    own = results.join(latest_reports(reports).select("report_id"), "report_id", "left_semi")
    counts = own.groupBy("rule_name").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))
    return counts.withColumn("pass_rate", F.round(F.col("passed") * 100.0 / F.col("total"), 2)).orderBy(F.desc("failed"), "rule_name").limit(top)


def severity_counts(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(severity, n) over the latest reports."""
    return results.join(latest_reports(reports).select("report_id"), "report_id", "left_semi").groupBy("severity").agg(F.count("*").alias("n"))


def severity_rollup(results: DataFrame) -> DataFrame:
    """(severity, rule_name, n, failed) by rule, severity and over all; null stands for all."""
    return results.rollup("severity", "rule_name").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))


def timeline(reports: DataFrame) -> DataFrame:
    """(project, executed_at, score, change): each report's score and its distance from the one before."""
    by_time = Window.partitionBy("project").orderBy("executed_at", "report_id")
    return reports.select("project", "executed_at", "score", F.round(F.col("score") - F.lag("score").over(by_time), 2).alias("change"))


def search_failures(failures: DataFrame, text: str) -> DataFrame:
    """Failures of which some value holds ``text``, in any case."""
    hit: Column = F.lit(False)
    for c in failures.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(text.lower())), F.lit(False))
    return failures.where(hit)


def report_page(reports: DataFrame, since: str | None = None, until: str | None = None, group: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Reports of a time range and group, newest first."""
    out = reports
    if since:
        out = out.where(F.col("executed_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("executed_at") <= F.lit(until).cast("timestamp"))
    if group:
        out = out.where(F.col("group_name") == group)
    return out.orderBy(F.desc("executed_at"), F.desc("report_id")).offset(offset).limit(limit)


def with_values(failures: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Stored failures with the source row of their row_id as JSON in ``values``."""
    rows = source.select(F.col(f"`{key}`").cast("string").alias("row_id"), F.to_json(F.struct("*")).alias("values"))
    return failures.join(rows, "row_id", "left")


def latest_actions(actions: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The last status (sin_accion, en_revision, solucionado) of each (report_id, rule_name, row_id); of equal times the first by the columns ``ties``, such as the place where a row is stored."""
    newest = Window.partitionBy("report_id", "rule_name", "row_id").orderBy(F.desc("changed_at"), *(ties or []))
    return actions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
