"""The weighted score of a report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights by severity, and the least score of each label.
WEIGHTS = {"error": 10, "warning": 5, "info": 2}
OTHER = 5
LABELS = [(90, "excelente"), (70, "aceptable"), (50, "deficiente")]


def score(parts: Iterable[tuple[str, float]]) -> float:
    """100 minus the weighted mean of failure percentages, at least 0; 100 without any."""
    weighed = [(WEIGHTS.get(s, OTHER), p) for s, p in parts]
    total = sum(w for w, _ in weighed)
    return round(max(0.0, 100 - sum(w * p for w, p in weighed) / total), 2) if total else 100.0


def label(value: float) -> str:
    return next((name for least, name in LABELS if value >= least), "critico")


def weight(severity: Column) -> Column:
    out = F.lit(OTHER)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def score_frame(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., score, label) of rule results (severity, failure_pct)."""
    w = weight(F.col("severity"))
    value = F.greatest(F.lit(0.0), 100 - F.sum(w * F.col("failure_pct")) / F.sum(w))
    name = F.lit("critico")
    for least, text in reversed(LABELS):
        name = F.when(F.col("score") >= least, text).otherwise(name)
    return results.groupBy(*(by or [])).agg(F.round(F.coalesce(value, F.lit(100.0)), 2).alias("score")).withColumn("label", name)
