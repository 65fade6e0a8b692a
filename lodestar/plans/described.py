"""What is wrong with each failing value, and what to do about it, as text.

The texts are chosen by expressions over the lazy frame of failures, so that they are made
where the rows are, however many fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.run import Report

# Texts of failing values by rule: what holds of the value, and what usually helps.
TEXTS: dict[str, tuple[str, str]] = {
    "null_check": ("{column} has no value", "Fill the cell in at the source, or say that the column is optional"),
    "duplicate_check": ("the row says the same as another: {value}", "Keep one of the rows"),
    "type_check": ("{column} holds '{value}', which isn't of the column's type", "Correct the value or cast the column"),
    "range_check": ("{column} is {value}, far from the other values", "See whether the value was mistyped or is in another unit"),
    "pattern_check": ("{column} is '{value}', which doesn't have the expected form", "Write the value in the form that the others have"),
    "unique_check": ("{column} is '{value}', as in another row", "Give the row a key of its own, or drop it"),
    "referential_integrity_check": ("{column} is '{value}', which no parent has", "Add the parent or correct the reference"),
    "missing_fk_check": ("{column} is '{value}', which no parent has", "Add the parent or correct the key"),
    "email_check": ("{column} is '{value}', which is no e-mail address", "Ask for the address again"),
    "phone_check": ("{column} is '{value}', which is no telephone number", "Write the number with its country code"),
    "zip_code_check": ("{column} is '{value}', which is no postal code", "Look the code up by the address"),
    "rfc_curp_check": ("{column} is '{value}', which is no valid RFC or CURP", "Compare it with the person's document"),
    "special_chars_check": ("{column} holds characters that don't belong there: '{value}'", "Strip or replace the characters, and read the file in its own encoding"),
    "string_length_check": ("{column} is too short or too long: '{value}'", "Shorten or complete the text"),
    "trim_check": ("{column} begins or ends with blanks: '{value}'", "Trim the value when it is loaded"),
    "case_consistency_check": ("{column} is '{value}', not in the case of the others", "Use the column's usual case"),
    "invalid_date_check": ("{column} is '{value}', which is no date", "Correct the date, and write all dates in one format"),
    "date_range_check": ("{column} is {value}, outside the range of dates", "Correct the year, or widen the range"),
    "date_inconsistency_check": ("{column} are in the wrong order: {value}", "See which of the dates is wrong"),
    "freshness_check": ("{column} is {value}, which is too long ago", "Load newer data"),
    "latency_check": ("{value} hours lie between {column}", "Look for delays on the way to the table"),
    "cross_consistency_check": ("the row breaks {column}: {value}", "Recompute the fields from each other"),
    "functional_dependency_check": ("{column} doesn't follow from its determinant: {value}", "Keep one value for each determinant"),
    "derived_column_check": ("{column} is {value}, not what its formula gives", "Compute the column anew"),
    "drift_check": ("{column} is '{value}', which the reference doesn't have", "Add the value to the reference, or correct it"),
    "row_completeness_check": ("the row is mostly empty, without {value}", "Complete the row or drop it"),
    "multivariate_outlier_check": ("the row's {column} are unlike those of other rows together: {value}", "Look at the row as a whole"),
    "fuzzy_name_match": ("the name '{value}' is much like another's (group {column})", "Compare the rows of the group, and merge those of one person"),
    "fuzzy_id_match": ("the number '{value}' is much like another's (group {column})", "Look for a mistyped digit"),
    "similar_dob": ("the birth date {value} is a few days from another's (group {column})", "Compare the rows of the group"),
    "person_composite_similarity": ("the row is much like another person's (group {column}): {value}", "Compare the rows of the group, and merge those of one person"),
    "personas_similares": ("the row is probably a person that another row has (group {column}): {value}", "Compare the rows of the group, and merge those of one person"),
    "custom_sql_rule": ("the query returns the row: {value}", "See why the query returns it"),
    "custom_expression_rule": ("the row breaks the predicate: {value}", "See which of its fields does"),
    "custom_python_rule": ("the function marks the row: {value}", "See why the function marks it"),
    "custom_code_rule": ("the code marks the row: {value}", "See why the code marks it"),
}
#: Characters of a value that a text shows.
SHOWN = 80


def _by_rule(values: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col("rule_name")], otherwise) if pairs else otherwise


def with_texts(failures: DataFrame, advice: dict[str, str] | None = None) -> DataFrame:
    """``failures`` (rule_name, column, row_id, value) with ``text`` and ``suggestion``; advice: suggestions for rules, before the usual ones.

    A null value is named so, a blank one is said to be blank; long ones are shown in part.
    """
    shown = F.when(F.length("value") > SHOWN, F.concat(F.left("value", F.lit(SHOWN - 1)), F.lit("…"))).otherwise(F.col("value"))
    template = _by_rule({k: t for k, (t, _) in TEXTS.items()}, F.lit("{column} is '{value}', which breaks the rule"))
    template = F.when((F.col("rule_name") == "null_check") & F.col("value").isNotNull(), F.lit("{column} is blank")).otherwise(template)
    text = F.replace(F.replace(template, F.lit("{column}"), F.col("column")), F.lit("{value}"), F.coalesce(shown, F.lit("null")))
    suggestion = _by_rule(advice or {}, _by_rule({k: s for k, (_, s) in TEXTS.items()}, F.lit("Look at the value in its source")))
    return failures.withColumns({"text": text, "suggestion": suggestion})


def described(report: Report) -> DataFrame:
    """(rule_name, severity, column, row_id, value, text, suggestion) of all failing rows of a report; computed when asked for."""
    severities = {f.rule_name: f.severity or "error" for f in report.findings}
    own = {f.rule_name: f.recommendation for f in report.findings if f.recommendation and f.rule_name not in TEXTS}
    rows = with_texts(report.failures(), own)
    return rows.select("rule_name", _by_rule(severities, F.lit("error")).alias("severity"), "column", "row_id", "value", "text", "suggestion")


def summarised(report: Report, top: int = 5) -> DataFrame:
    """(rule_name, column, failures, examples): how many rows fail by rule and column, with up to ``top`` of the texts, the most frequent first."""
    rows = described(report)
    each = rows.groupBy("rule_name", "column", "text").agg(F.count("*").alias("n"))
    counts = each.groupBy("rule_name", "column").agg(F.sum("n").alias("failures"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("rule_name", "column").orderBy(F.desc("n"), "text"))).where(F.col("rank") <= top)
    examples = ranked.groupBy("rule_name", "column").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("e")).select("rule_name", "column", F.col("e.text").alias("examples"))
    return counts.join(examples, ["rule_name", "column"])
