"""Rules over a stream with kept state: the same findings as over all rows so far."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.plans.run import run_checks
from lodestar.streaming.monitor import monitor_stream

RULES = "nullity,string_length,trim_check,email_valid,row_completeness,date_range,invalid_dates,freshness,custom_expression"
CONFIGS = {"custom_expression": {"expression": "n < 90"}, "date_range": {"min_year": 2024}}
AS_OF = "2024-03-01 00:00:00"
SCHEMA = "n long, name string, email string, place string, at timestamp"


def part(spark, low, high):
    df = spark.range(low, high)
    n = F.col("id")
    return df.select(n.alias("n"), F.when(n % 4 > 0, F.concat(F.when(n % 6 == 0, " ").otherwise(""), F.lit("name"), n.cast("string"))).alias("name"), F.when(n % 5 == 0, "bad@").otherwise("a@b.org").alias("email"), F.when(n % 3 == 0, "north").otherwise("south").alias("place"), (F.lit("2023-12-31 00:00:00").cast("timestamp") + F.make_dt_interval((n % 9).cast("int"))).alias("at"))


def facts(report):
    return {f.rule_name: (f.total, f.failed, f.failure_pct, f.passed, f.errored, str(f.details)) for f in report.findings}


def watch(spark, source, checkpoint, **more):
    got = []
    query = monitor_stream(spark.readStream.schema(SCHEMA).parquet(source), RULES, lambda reports, number: got.append((number, reports)), checkpoint, CONFIGS, as_of=AS_OF, **more)
    query.awaitTermination(120)
    assert query.exception() is None
    return got


def test_all_rows_so_far_over_restarts(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    seen = None
    for k, (low, high) in enumerate([(0, 60), (60, 75), (75, 120)]):
        part(spark, low, high).coalesce(1).write.mode("append").parquet(source)
        got = watch(spark, source, checkpoint)  # a query of its own each time: the state is the checkpoint's
        seen = facts(got[-1][1][()])
        assert seen == facts(run_checks(part(spark, 0, high), RULES, CONFIGS, as_of=AS_OF)), k
    assert seen["custom_expression_rule"][:2] == (120, 30) and not any(v[4] for v in seen.values())


def test_groups(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    part(spark, 0, 80).coalesce(1).write.parquet(source)
    watch(spark, source, checkpoint, by=["place"])
    part(spark, 80, 100).where("place = 'north'").coalesce(1).write.mode("append").parquet(source)
    (_, reports), = watch(spark, source, checkpoint, by=["place"])
    assert set(reports) == {("north",)}  # the group that the batch touched
    own = part(spark, 0, 100).where("place = 'north'").drop("place")
    assert facts(reports["north",]) == facts(run_checks(own, RULES, CONFIGS, as_of=AS_OF))


def test_windows_drop_late_rows(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    options = {"window": ("at", "1 day"), "watermark": "2 days"}
    part(spark, 0, 90).coalesce(1).write.parquet(source)
    (_, first), *_ = watch(spark, source, checkpoint, **options)
    assert len(first) == 9 and all(r.findings[0].total == 10 * 5 for r in first.values())
    part(spark, 90, 99).coalesce(1).write.mode("append").parquet(source)  # days 0 to 8; days 0 to 5 are behind the watermark
    got = watch(spark, source, checkpoint, **options)
    touched = {k[0].date(): r.findings[0].total for _, reports in got for k, r in reports.items()}
    late = dt.date(2024, 1, 8) - dt.timedelta(days=2)
    assert touched and all(n == 11 * 5 for n in touched.values()) and min(touched) >= late


def test_rules_that_state_cannot_keep(spark, tmp_path):
    source = str(tmp_path / "in")
    part(spark, 0, 30).coalesce(1).write.parquet(source)
    got = []
    query = monitor_stream(spark.readStream.schema(SCHEMA).parquet(source), "nullity,ranges,cardinality", lambda reports, _: got.append(reports), str(tmp_path / "state"))
    query.awaitTermination(120)
    found = {f.rule_name: f for f in got[0][()].findings}
    assert found["range_check"].errored and "q:n" in found["range_check"].details[0]["error"]
    assert not found["null_check"].errored and found["null_check"].failed > 0
