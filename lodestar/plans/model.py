"""What a check returns, and how checks ask for shared aggregates."""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from lodestar.functions.quantiles import Quantiles



@dataclass(frozen=True)
class Distinct:
    """An ask for the number of different values, nulls left out; an aggregate column would print like a plain count."""

    column: Column


#: A check yields named aggregate columns, or asks for distinct counts or quantiles, and gets their values; all checks' columns of a round are one job.
Ask = dict[str, Column | Distinct | Quantiles]
Check = Generator[Ask, dict[str, Any], "Finding"]


@dataclass
class Finding:
    """details: one dict for each column, pair or value looked at; failures: lazy rows."""

    passed: bool
    total: int
    failed: int
    failure_pct: float
    details: list[dict[str, Any]] = field(default_factory=list)
    failures: DataFrame | None = None
    recommendation: str | None = None
    severity: str | None = None
    rule_name: str = ""
    description: str = ""
    errored: bool = False
    duration_ms: float = 0.0


def percent(failed: float, total: float) -> float:
    return round(failed / total * 100, 2) if total else 0.0


def finding(total: int, failed: int, details: list[dict[str, Any]] | None = None, failures: DataFrame | None = None, advice: str | None = None, **more: Any) -> Finding:
    """The usual finding: passed if nothing failed."""
    values = {"passed": failed == 0, "failure_pct": percent(failed, total)} | more
    return Finding(total=int(total), failed=int(failed), details=details or [], failures=failures, recommendation=None if values["passed"] else advice, **values)


@dataclass(frozen=True)
class Rule:
    key: str
    name: str
    severity: str
    description: str
    check: Callable[..., Check]
