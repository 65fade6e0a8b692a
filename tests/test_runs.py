"""Runs in the background: progress, cancelling, and running again."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestar.__main__ import main
from lodestar.plans.registry import RULES, rule
from lodestar.plans.run import Cancelled, run_checks
from lodestar.plans.model import finding
from lodestar.plans.runs import Run, RunSpec, rerun, run_history
from lodestar.sources.spec import SourceSpec


@pytest.fixture
def orders(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.range(200).select("id", F.when(F.col("id") % 4 > 0, F.lit("x")).alias("name"), F.rand(1).alias("v")).write.parquet(path)
    return SourceSpec("parquet", path, columns=("id", "name", "v"))


@pytest.fixture
def slow():
    """A rule that takes minutes, and says when it has begun."""
    began = threading.Event()

    @F.udf("long")
    def late(x):
        time.sleep(5)
        return x

    @rule("slow_test_rule", "slow_test_rule", "Takes its time")
    def check(t, **_):
        began.set()
        got = yield {"n": F.max(late(t.c("id")))}
        return finding(got["n"], 0)

    yield began
    del RULES["slow_test_rule"]


def test_progress(spark, orders):
    run = Run(spark, RunSpec(orders, "nullity,ranges,custom_expression", {"custom_expression": {"expression": "id >= 0"}}, key="id"))
    events = list(run.events())
    kinds = [e.kind for e in events]
    assert kinds[0] == "started" and kinds[-1] == "done" and "round" in kinds
    named = [e for e in events if e.kind == "rule"]
    assert [e.done for e in named] == [1, 2, 3] and {e.total for e in named} == {3}
    assert {e.name for e in named} == {"null_check", "range_check", "custom_expression_rule"}
    assert all(a.seconds <= b.seconds for a, b in zip(events, events[1:], strict=False))
    done, total = run.tasks()
    assert 0 < done <= total
    plain = run_checks(orders.to_df(spark), "nullity,ranges", key="id")
    assert [(f.rule_name, f.failed) for f in run.result().findings][:2] == [(f.rule_name, f.failed) for f in plain.findings]
    assert run.result().finding("null_check").failed == 50


def test_cancel(spark, orders, slow, tmp_path):
    runs = str(tmp_path / "runs")
    began = time.perf_counter()
    run = Run(spark, RunSpec(orders, "nullity,slow_test_rule"), runs)
    assert slow.wait(60)
    with pytest.raises(TimeoutError):
        run.result(timeout=2)
    run.cancel()
    assert time.perf_counter() - began < 50
    assert run.status == "cancelled" and [e.kind for e in run.events()][-1] == "cancelled"
    with pytest.raises(Cancelled):
        run.result()
    assert spark.range(10).count() == 10 and run.tag not in spark.sparkContext.getJobTags()  # the session goes on
    assert [(r["run_id"], r["status"], r["score"]) for r in run_history(spark, runs).collect()] == [(run.id, "cancelled", None)]


def test_cancel_leaves_other_runs_alone(spark, orders, slow):
    stopped, other = Run(spark, RunSpec(orders, "slow_test_rule")), Run(spark, RunSpec(orders, "nullity"))
    assert slow.wait(60)
    stopped.cancel()
    assert other.result(60).findings[0].failed == 50 and other.status == "done"


def test_rerun(spark, orders, tmp_path):
    runs = str(tmp_path / "runs")
    spec = RunSpec(orders, "nullity", {"nullity": {"severity": "warning"}}, as_of="2024-01-01 00:00:00")
    assert RunSpec.of_json(spec.to_json()) == spec
    first = Run(spark, spec, runs)
    before = first.result(60)
    spark.range(100).select("id", F.lit(None).cast("string").alias("name"), F.rand(1).alias("v")).write.mode("append").parquet(orders.path)
    again = rerun(spark, runs, first.id)
    assert again.result(60).findings[0].failed == before.findings[0].failed + 100 == 150
    history = {r["run_id"]: r for r in run_history(spark, runs).collect()}
    assert {k: r["status"] for k, r in history.items()} == {first.id: "done", again.id: "done"}
    assert history[again.id]["failed_rules"] == 1 and history[again.id]["spec"] == spec.to_json() and history[first.id]["score"] == before.score
    with pytest.raises(ValueError, match="no run"):
        rerun(spark, runs, "unknown")


def test_failed_run(spark, tmp_path):
    runs = str(tmp_path / "runs")
    run = Run(spark, RunSpec(SourceSpec("parquet", str(tmp_path / "missing"))), runs)
    assert [e.kind for e in run.events()][-1] == "failed"
    with pytest.raises(RuntimeError, match="(?i)path"):
        run.result()
    assert run_history(spark, runs).first()["status"] == "failed"


def test_command_line(spark, orders, tmp_path, capsys):
    runs = str(tmp_path / "runs")
    assert main(["run", orders.path, "--kind", "parquet", "--rules", "nullity", "--runs", runs]) == 0
    out = capsys.readouterr().out
    assert "null_check" in out and "done" in out
    run_id = run_history(spark, runs).first()["run_id"]
    assert main(["rerun", run_id, "--runs", runs]) == 0
    assert run_history(spark, runs).count() == 2
