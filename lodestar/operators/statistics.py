"""Outliers, distributions, correlations, completeness of rows, multivariate outliers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.numeric import IsolationTrees, isolation_trees, omnibus, shapiro_wilk, variance_inflation
from lodestar.functions.quantiles import Quantiles, exact_quantiles
from lodestar.functions.table import ROW_ID, Table, canonical
from lodestar.plans.model import Check, Distinct, Finding, finding, percent
from lodestar.plans.registry import rule
from lodestar.plans.run import condition

#: Rows that the isolation trees are grown on, at most.
FOREST_ROWS = 100_000
#: Values up to which normality is tested by Shapiro and Wilk's W, which needs them in order; beyond, by moments.
NORMALITY_ROWS = 5000
#: Values from which on the moments' distributions are close to what the omnibus test takes them for.
LEAST_OMNIBUS = 20


def fences(c: Column, q1: float, q3: float) -> Column:
    return (c < q1 - 1.5 * (q3 - q1)) | (c > q3 + 1.5 * (q3 - q1))


@rule("ranges", "range_check", "Numbers far from the others", severity="warning")
def ranges(t: Table, z_score_threshold: float = 3.0, **_) -> Check:
    """Outside 1.5 interquartile ranges, or more than so many standard deviations from the mean; failed counts rows of either kind."""
    ask = {}
    for c in t.numeric:
        x = t.c(c).cast("double")
        ask |= {f"n:{c}": F.count(x), f"q:{c}": Quantiles(x, (0.25, 0.75)), f"m:{c}": F.avg(x), f"s:{c}": F.stddev_samp(x), f"lo:{c}": F.min(x), f"hi:{c}": F.max(x)}
    got = (yield ask) if ask else {}
    own = [c for c in t.numeric if got[f"n:{c}"] >= 4]
    kinds = {}
    for c in own:
        x, (q1, q3), s = t.c(c).cast("double"), got[f"q:{c}"], got[f"s:{c}"]
        iqr = condition(fences(x, q1, q3))
        z = condition(F.abs(x - got[f"m:{c}"]) / s > z_score_threshold) if s else F.lit(False)
        kinds[c] = (iqr, z, iqr | z, x)
    counts = (yield {k: v for c, (iqr, z, either, x) in kinds.items() for k, v in ((f"i:{c}", F.count_if(iqr)), (f"z:{c}", F.count_if(z)), (f"e:{c}", F.count_if(either)))}) if own else {}
    distinct = (yield {f"d:{c}": Distinct(F.when(kinds[c][2], kinds[c][3])) for c in own}) if own else {}
    details = []
    for c in own:
        q1, q3 = got[f"q:{c}"]
        width = 1.5 * (q3 - q1)
        details.append({"column": c, "min": got[f"lo:{c}"], "max": got[f"hi:{c}"], "q1": round(q1, 4), "q3": round(q3, 4), "lower": round(q1 - width, 4), "upper": round(q3 + width, 4), "iqr_outliers": counts[f"i:{c}"], "z_outliers": counts[f"z:{c}"], "outlier_rows": counts[f"e:{c}"], "distinct_outlier_values": distinct[f"d:{c}"], "total": got[f"n:{c}"]})
    failures = t.failures("range_check", [(c, kinds[c][2], t.c(c)) for c in own])
    return finding(sum(got[f"n:{c}"] for c in t.numeric), sum(d["outlier_rows"] for d in details), details, failures, "Check the outlying values")


@rule("distributions", "distribution_check", "Columns that are skewed, heavy-tailed or not normal", severity="warning")
def distributions(t: Table, shapiro_threshold: float = 0.05, max_rows: int = NORMALITY_ROWS, **_) -> Check:
    """Population skewness over 1, excess kurtosis over 3 (absolute values), or normality less likely than the threshold, in columns of 4 or more values.

    Up to ``max_rows`` values normality is judged by the Shapiro-Wilk test over the values
    themselves, beyond by the omnibus test of D'Agostino and Pearson, whose moments add up in
    tasks; ``test`` in the details names it.
    """
    x = {c: t.c(c).cast("double") for c in t.numeric}
    got = (yield {k: v for c in t.numeric for k, v in ((f"n:{c}", F.count(x[c])), (f"s:{c}", F.skewness(x[c])), (f"k:{c}", F.kurtosis(x[c])), (f"o:{c}", _omnibus(x[c])))}) if x else {}
    own = [c for c in t.numeric if got[f"n:{c}"] >= 4]
    short = [c for c in own if got[f"n:{c}"] <= max_rows]
    values = (yield {c: F.collect_list(x[c]) for c in short}) if short else {}  # bounded by max_rows
    details = []
    for c in own:
        skew, kurtosis = got[f"s:{c}"] or 0.0, got[f"k:{c}"] or 0.0
        if c in values:
            w, p = shapiro_wilk(np.array(values[c]))
            tested = {"test": "shapiro_wilk", "statistic": round(w, 4), "p": round(p, 6), "shapiro_w": round(w, 4), "shapiro_p": round(p, 6)}
        else:
            k2 = got[f"o:{c}"]
            p = None if k2 is None else float(np.exp(-k2 / 2))
            tested = {"test": "dagostino_pearson", "statistic": k2 and round(k2, 4), "p": p if p is None else round(p, 6), "shapiro_w": None, "shapiro_p": None}
        issues = [name for name, bad in (("NON_NORMAL", p is not None and p < shapiro_threshold), ("SKEWED", abs(skew) > 1), ("HEAVY_TAILS", abs(kurtosis) > 3)) if bad]
        if issues:
            details.append({"column": c, "issues": ",".join(issues), "skewness": round(skew, 4), "kurtosis": round(kurtosis, 4), **tested})
    return finding(len(own), len(details), details, None, "Consider transforming the skewed columns")


def _omnibus(x: Column) -> Column:
    return F.when(F.count(x) >= LEAST_OMNIBUS, omnibus(F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)))


def normality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, skewness, kurtosis, k2, p) of the numeric columns: the omnibus test of D'Agostino and Pearson.

    k2 adds up how far the skewness and the kurtosis of a sample are from those of normal
    ones, p is the chance of as much; both are null for constant columns and under ``LEAST_OMNIBUS`` values.
    """
    t = Table(canonical(df))
    own = [c for c in t.numeric if columns is None or c in columns]
    x = [t.c(c).cast("double") for c in own]
    rows = [F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), _omnibus(v).alias("k2")) for c, v in zip(own, x, strict=True)]
    schema = "column string, n long, skewness double, kurtosis double, k2 double"
    if not rows:
        return df.sparkSession.createDataFrame([], f"{schema}, p double")
    found = t.df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return found.withColumn("p", F.exp(-F.col("k2") / 2))


def correlation_columns(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Rows without nulls, and their Pearson matrix; constant columns are NaN.  One job."""
    col = lambda c: F.col(f"`{c}`").cast("double")
    pairs = list(combinations(columns, 2))
    whole = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    place = {c: i for i, c in enumerate(columns)}
    row = whole.agg(F.count("*").alias("n"), *(F.stddev_samp(f"c{i}").alias(f"s{i}") for i in range(len(columns))), *(F.covar_samp(f"c{place[a]}", f"c{place[b]}").alias(f"v{k}") for k, (a, b) in enumerate(pairs))).first()
    r = np.eye(len(columns))
    s = [row[f"s{i}"] or 0.0 for i in range(len(columns))]
    for k, (a, b) in enumerate(pairs):
        i, j = place[a], place[b]
        r[i, j] = r[j, i] = row[f"v{k}"] / (s[i] * s[j]) if s[i] and s[j] else np.nan
    return row["n"], np.clip(r, -1, 1)


@rule("correlations", "correlation_check", "Columns that say the same", severity="warning")
def correlations(t: Table, vif_threshold: float = 10, corr_threshold: float = 0.8, **_) -> Check:
    if len(t.numeric) < 2:
        return Finding(True, len(t.numeric), 0, 0.0)
    yield {"rows": F.count("*")}
    n, r = correlation_columns(t.df, t.numeric)
    if n < 3:
        return Finding(True, len(t.numeric), 0, 0.0, [{"note": "too few complete rows"}])
    details = [{"a": t.numeric[i], "b": t.numeric[j], "r": round(float(r[i, j]), 4), "issue": "HIGH_CORRELATION"} for i, j in combinations(range(len(r)), 2) if abs(r[i, j]) > corr_threshold]
    fine = [i for i in range(len(r)) if not np.isnan(r[i][[k for k in range(len(r)) if k != i]]).all()]
    vif = variance_inflation(np.nan_to_num(r[np.ix_(fine, fine)])) if len(fine) > 1 else np.ones(len(fine))
    details += [{"column": t.numeric[i], "vif": float(v) if np.isinf(v) else round(float(v), 4), "issue": "HIGH_VIF"} for i, v in zip(fine, vif, strict=True) if v > vif_threshold]
    pairs = len(t.numeric) * (len(t.numeric) - 1) // 2
    return finding(pairs + len(fine), len(details), details, None, "Drop or combine columns that say the same")


def filled(t: Table) -> Column:
    """The share of non-null cells of a row, in percent."""
    return F.lit(100.0) * sum((F.when(t.c(c).isNotNull(), 1).otherwise(0) for c in t.columns), F.lit(0)) / F.lit(max(len(t.columns), 1))


@rule("row_completeness", "row_completeness_check", "Rows that are mostly empty", severity="warning")
def row_completeness(t: Table, min_completeness_pct: float = 30, **_) -> Check:
    share = filled(t)
    got = yield {"rows": F.count("*"), "f": F.count_if(share < min_completeness_pct), "avg": F.avg(share), "min": F.min(share)}
    empty = F.concat_ws(",", F.slice(F.filter(F.array(*(F.when(t.c(c).isNull(), F.lit(c)) for c in t.columns)), lambda x: x.isNotNull()), 1, 10))
    details = [{"avg_completeness": got["avg"] and round(got["avg"], 2), "min_completeness": got["min"] and round(got["min"], 2), "failed": got["f"], "total": got["rows"]}]
    return finding(got["rows"], got["f"], details, t.failures("row_completeness_check", [("*", share < min_completeness_pct, empty)]), "Drop or complete the rows that are mostly empty")


def forest_scores(df: DataFrame, columns: list[str], fit_rows: int = FOREST_ROWS, seed: int = 42) -> DataFrame:
    """``df`` with anomaly_score by a forest of its own; null where one of ``columns`` is null.

    Trees are grown on at most ``fit_rows`` complete rows, those of smallest hash.
    """
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    sample = df.select(*(v.alias(f"x{i}") for i, v in enumerate(x))).dropna().orderBy(F.xxhash64(*(f"x{i}" for i in range(len(x))))).limit(fit_rows).toPandas().to_numpy(float)
    return scored_by(df, columns, isolation_trees(sample, seed=seed))


def scored_by(df: DataFrame, columns: list[str], trees: IsolationTrees) -> DataFrame:
    """``df`` with anomaly_score by a given forest: 2 to the power of minus the mean path length over the usual one; null where one of ``columns`` is null."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(trees.scores(np.array(rows.tolist(), float).reshape(-1, len(columns))))

    complete = F.lit(True)
    for v in x:
        complete = complete & v.isNotNull()
    filled_in = F.array(*(F.coalesce(v, F.lit(0.0)) for v in x))
    return df.withColumn("_complete", complete).withColumn("anomaly_score", F.when(F.col("_complete"), score(filled_in))).drop("_complete")


@rule("multivariate_outliers", "multivariate_outlier_check", "Rows unlike the others in all numbers together", severity="warning")
def multivariate_outliers(t: Table, contamination: float = 0.05, seed: int = 42, **_) -> Check:
    if len(t.numeric) < 2:
        return Finding(True, 0, 0, 0.0, [{"note": "fewer than two numeric columns"}])
    got = yield {"n": F.count_if(sum((F.when(t.c(c).isNull(), 1).otherwise(0) for c in t.numeric), F.lit(0)) == 0)}
    if got["n"] < 10:
        return Finding(True, got["n"], 0, 0.0, [{"note": "fewer than ten complete rows"}])
    scored = forest_scores(t.df.select(ROW_ID, *(t.c(c) for c in t.numeric)), t.numeric, seed=seed).where("anomaly_score is not null")
    cut = exact_quantiles(scored, [Quantiles(F.col("anomaly_score"), (1 - contamination,))])[0][0]
    flagged = scored.where(F.col("anomaly_score") > cut)
    failed = flagged.count()
    failures = flagged.select(F.lit("multivariate_outlier_check").alias("rule_name"), F.lit(",".join(t.numeric[:5])).alias("column"), F.col(ROW_ID).alias("row_id"), F.concat_ws(",", *(t.c(c).cast("string") for c in t.numeric[:5])).alias("value"))
    return finding(got["n"], failed, [{"columns": t.numeric, "threshold": round(cut, 4), "failed": failed, "pct": percent(failed, got["n"])}], failures, "Check the rows that are unlike the others")
