"""Texts of failing values."""

from lodestar.plans.described import TEXTS, described, summarised, with_texts
from lodestar.plans.registry import RULES, load
from lodestar.plans.report import as_dict
from lodestar.plans.run import run_checks


def test_texts_of_values(spark):
    rows = [("null_check", "name", "1", None), ("null_check", "name", "2", "  "), ("email_check", "mail", "3", "a'@{column}"), ("range_check", "v", "4", "1e9"), ("string_length_check", "note", "5", "x" * 200), ("own rule", "c", "6", "q"), ("other", "c", None, None)]
    df = spark.createDataFrame(rows, "rule_name string, column string, row_id string, value string")
    got = {r["row_id"]: (r["text"], r["suggestion"]) for r in with_texts(df, {"own rule": "Ask Ana"}).collect()}
    assert got["1"][0] == "name has no value" and got["2"][0] == "name is blank"
    assert got["3"] == ("mail is 'a'@{column}', which is no e-mail address", TEXTS["email_check"][1])
    assert got["4"][0] == "v is 1e9, far from the other values"
    assert got["5"][0] == "note is too short or too long: '" + "x" * 79 + "…'"
    assert got["6"] == ("c is 'q', which breaks the rule", "Ask Ana") and got[None][0].startswith("c is 'null'")
    assert with_texts(df.limit(0)).collect() == []


def test_report_texts(spark):
    df = spark.createDataFrame([(k, "x@" if k % 2 else "a@b.org", None if k % 5 == 0 else "n") for k in range(40)], "id long, email string, name string")
    report = run_checks(df, "nullity,email_valid", {"nullity": {"severity": "warning"}}, key="id")
    rows = described(report).collect()
    assert len(rows) == 28 and {(r["rule_name"], r["severity"]) for r in rows} == {("null_check", "warning"), ("email_check", report.finding("email_check").severity)}
    assert all(r["text"] == "name has no value" for r in rows if r["rule_name"] == "null_check")
    summary = {(r["rule_name"], r["column"]): (r["failures"], r["examples"]) for r in summarised(report).collect()}
    assert summary == {("null_check", "name"): (8, ["name has no value"]), ("email_check", "email"): (20, ["email is 'x@', which is no e-mail address"])}
    shown = as_dict(report)["results"][0]["failures"][0]
    assert shown["text"] == "name has no value" and shown["suggestion"] == TEXTS["null_check"][1]


def test_every_rule_with_failing_rows_has_its_text():
    load()
    silent = {"cardinality_check", "distribution_check", "correlation_check", "class_balance_check", "boolean_bias_check", "schema_evolution_check", "volume_anomaly_check", "sequential_integrity_check"}  # nothing fails row by row
    assert {r.name for r in RULES.values()} - silent <= set(TEXTS)
