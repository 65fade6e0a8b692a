"""Running checks: their aggregates are fused, round by round, into few jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.quantiles import Quantiles, exact_quantiles
from lodestar.functions.table import Table, canonical
from lodestar.plans import score as scoring
from lodestar.plans.model import Ask, Check, Distinct, Finding, Rule
from lodestar.plans.registry import resolve

#: Aggregates of one job; more than some hundreds outgrow generated code.
WIDTH = 300
RESULT = "rule_name string, description string, severity string, passed boolean, total long, failed long, failure_pct double, recommendation string, duration_ms double, errored boolean"
DETAIL = "rule_name string, position int, metrics map<string,string>"
FAILURE = "rule_name string, column string, row_id string, value string"


class Cancelled(Exception):
    """A run that was told to stop."""


@dataclass
class Report:
    spark: SparkSession
    findings: list[Finding]

    @property
    def score(self) -> float:
        return scoring.score([(f.severity or "error", f.failure_pct) for f in self.findings])

    @property
    def label(self) -> str:
        return scoring.label(self.score)

    def results(self) -> DataFrame:
        return self.spark.createDataFrame([(f.rule_name, f.description, f.severity, f.passed, f.total, f.failed, float(f.failure_pct), f.recommendation, f.duration_ms, f.errored) for f in self.findings], RESULT)

    def details(self) -> DataFrame:
        rows = [(f.rule_name, i, {k: _text(v) for k, v in d.items()}) for f in self.findings for i, d in enumerate(f.details)]
        return self.spark.createDataFrame(rows, DETAIL)

    def failures(self) -> DataFrame:
        """Failing rows of all rules; computed when asked for, never collected here."""
        frames = [f.failures for f in self.findings if f.failures is not None]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], FAILURE)

    def recommendations(self) -> list[dict[str, Any]]:
        return [{"rule": f.rule_name, "severity": f.severity, "text": f.recommendation} for f in self.findings if not f.passed and f.recommendation]

    def finding(self, key_or_name: str) -> Finding:
        return next(f for f in self.findings if key_or_name == f.rule_name)


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def shared(df: DataFrame, asks: list[Ask]) -> list[dict[str, Any]]:
    """The values of several asks; equal expressions are computed once.

    Distinct counts expand rows, so they go in jobs of their own; all quantiles are selected together.
    """
    plain: dict[str, Column] = {}
    distinct: dict[str, Column] = {}
    selected: dict[str, Quantiles] = {}
    names: list[dict[str, str]] = []
    for ask in asks:
        own = {}
        for label, column in ask.items():
            text = str(column)
            own[label] = text
            if isinstance(column, Quantiles):
                selected[text] = column
            elif isinstance(column, Distinct):
                distinct[text] = F.countDistinct(column.column)
            else:
                plain[text] = column
        names.append(own)
    values: dict[str, Any] = dict(zip(selected, exact_quantiles(df, list(selected.values())), strict=True))
    for part in (plain, distinct):
        items = list(part.items())
        for i in range(0, len(items), WIDTH):
            some = items[i : i + WIDTH]
            row = df.agg(*(c.alias(f"m{k}") for k, (_, c) in enumerate(some))).first()
            values |= {text: row[k] for k, (text, _) in enumerate(some)}
    return [{label: values[text] for label, text in own.items()} for own in names]


def _error(rule: Rule, problem: Exception) -> Finding:
    return Finding(passed=False, total=0, failed=0, failure_pct=0.0, details=[{"error": str(problem)[:500]}], errored=True, recommendation=f"The rule could not be evaluated: {type(problem).__name__}")


def run_checks(df: DataFrame, rules: str | Iterable[str] = "todo", configs: dict[str, dict[str, Any]] | None = None, key: str | None = None, as_of: str | None = None) -> Report:
    """A report of the rules over ``df``.

    configs: arguments of single rules by key; key: a column that names rows; as_of: the
    timestamp that date rules take for now.  A rule that fails to run becomes an errored
    finding and doesn't lower the score.
    """
    return run_rules(Table(canonical(df, key), as_of), [(r, (configs or {}).get(r.key, {})) for r in resolve(rules)])


def run_rules(table: Table, rules: list[tuple[Rule, dict[str, Any]]], tell: Callable[[str, str], None] = lambda kind, name: None) -> Report:
    """A report of ``rules`` with their arguments; tell hears ("round", number) and ("rule", name), and may raise ``Cancelled``."""
    findings: list[Finding | None] = [None] * len(rules)
    waiting: list[tuple[int, Check, Ask]] = []
    began = [time.perf_counter()] * len(rules)

    def step(i: int, check: Check | None, values: dict[str, Any] | None) -> None:
        rule, config = rules[i]
        try:
            check = check or rule.check(table, **config)
            waiting.append((i, check, next(check) if values is None else check.send(values)))
        except StopIteration as done:
            findings[i] = done.value
        except Cancelled:
            raise
        except Exception as problem:  # noqa: BLE001  one rule's problem is its own finding
            findings[i] = _error(rule, problem)
        if (f := findings[i]) is not None:
            f.rule_name, f.description, f.severity = rule.name, rule.description, f.severity or config.get("severity") or rule.severity
            f.duration_ms = (time.perf_counter() - began[i]) * 1000
            tell("rule", rule.name)

    for i in range(len(rules)):
        began[i] = time.perf_counter()
        step(i, None, None)
    rounds = 0
    while waiting:
        now, waiting, rounds = waiting, [], rounds + 1
        tell("round", str(rounds))
        try:
            answers: list[dict[str, Any] | Exception] = list(shared(table.df, [ask for _, _, ask in now]))
        except Exception:  # noqa: BLE001  some expression is at fault: ask one by one
            answers = []
            for _, _, ask in now:
                tell("round", str(rounds))
                try:
                    answers += shared(table.df, [ask])
                except Exception as problem:  # noqa: BLE001
                    answers.append(problem)
        for (i, check, _), answer in zip(now, answers, strict=True):
            if isinstance(answer, Exception):
                check.close()
                rule = rules[i][0]
                findings[i] = _error(rule, answer)
                findings[i].rule_name, findings[i].description, findings[i].severity = rule.name, rule.description, rule.severity
                tell("rule", rule.name)
            else:
                step(i, check, answer)
    return Report(table.df.sparkSession, [f for f in findings if f is not None])


def condition(column: Column) -> Column:
    """A predicate with null as false."""
    return F.coalesce(column, F.lit(False))
