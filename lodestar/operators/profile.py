"""Column profiles: overview, numbers, categories, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.quantiles import Quantiles, exact_quantiles
from lodestar.functions.table import ROW_ID, Table, canonical
from lodestar.operators.business import top_shares
from lodestar.operators.completeness import value_counts


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]], kinds: dict[str, str]) -> DataFrame:
    """One row for each column, from one aggregation: aggregates by column and name, kinds by name."""
    wide = df.agg(*(a.cast(kinds[n]).alias(f"{i}_{n}") for i, own in enumerate(aggregates.values()) for n, a in own.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{i}_{n}").alias(n) for n in own)) for i, (c, own) in enumerate(aggregates.items())))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def overview(df: DataFrame) -> DataFrame:
    """(rows, columns, cells, nulls, null_pct, duplicate_rows): one row."""
    t = Table(canonical(df))
    own = [F.col(f"`{c}`").cast("string") for c in t.comparable]
    nulls = reduce(lambda a, b: a + b, (F.count_if(t.c(c).isNull()) for c in t.columns), F.lit(0))
    base = t.df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls"))
    distinct = t.df.select(*(c.alias(f"c{i}") for i, c in enumerate(own))).distinct().agg(F.count("*").alias("distinct_rows"))
    cells = F.col("rows") * len(t.columns)
    return base.crossJoin(F.broadcast(distinct)).select("rows", F.lit(len(t.columns)).cast("long").alias("columns"), cells.alias("cells"), "nulls", F.round(F.coalesce(F.try_divide(F.col("nulls") * 100.0, cells), F.lit(0.0)), 2).alias("null_pct"), (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def corrected(skewness: Column, kurtosis: Column, n: Column) -> tuple[Column, Column]:
    """Sample-corrected forms of population skewness and excess kurtosis."""
    g1 = F.when(n > 2, skewness * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurtosis + 6))
    return g1, g2


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, nulls, mean, std, min, q1, median, q3, max, iqr, skewness, kurtosis) of the numeric columns."""
    t = Table(canonical(df))
    own = [c for c in t.numeric if columns is None or c in columns]
    kinds = dict.fromkeys(["mean", "std", "min", "max", "g1", "g2"], "double") | {"n": "long", "nulls": "long"}
    x = {c: t.c(c).cast("double") for c in own}
    got = _long(t.df, {c: {"n": F.count(v), "nulls": F.count_if(v.isNull()), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "g1": F.skewness(v), "g2": F.kurtosis(v)} for c, v in x.items()}, kinds)
    quartiles = exact_quantiles(t.df, [Quantiles(v, (0.25, 0.5, 0.75)) for v in x.values()])
    cuts = df.sparkSession.createDataFrame(list(zip(own, quartiles, strict=True)), "column string, q array<double>")
    got = got.join(F.broadcast(cuts), "column")
    skew, kurt = corrected(F.col("g1"), F.col("g2"), F.col("n").cast("double"))
    r = lambda c: F.round(c, 4)
    return got.select("column", "n", "nulls", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q3"), "max", r(F.col("q")[2] - F.col("q")[0]).alias("iqr"), r(skew).alias("skewness"), r(kurt).alias("kurtosis"))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_distinct, top_value, top_n, top_pct) of the text columns."""
    t = Table(canonical(df))
    own = [c for c in t.text if columns is None or c in columns]
    return top_shares(t.df, own).withColumn("top_pct", F.round(F.col("top_n") * 100.0 / F.col("n"), 2))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, value, n, rank) of the k most frequent values of each column; of equal counts the smaller values come first."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, columns).where("value is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))  # an int limit reaches the tasks before the shuffle


def temporal_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, min, max, range_days, frequency) of the date columns.

    frequency is the one distance of neighbouring dates in days, such as 2d; monthly for one
    date a month, always on the same day or always on the last; or irregular.
    """
    t = Table(canonical(df))
    own = [c for c in t.temporal if columns is None or c in columns]
    x = {c: t.c(c).cast("timestamp") for c in own}
    got = _long(t.df, {c: {"n": F.count(v), "min": F.min(v), "max": F.max(v)} for c, v in x.items()}, {"n": "long", "min": "timestamp", "max": "timestamp"})
    steps = []
    for c in own:
        # n distinct dates have one distance if all lie at multiples of the span over n - 1; no order is needed
        days = t.df.where(t.c(c).isNotNull()).select(t.c(c).cast("date").alias("d")).distinct()
        ends = days.agg(F.count("*").alias("k"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("k > 1")
        step = F.datediff("hi", "lo") / (F.col("k") - 1)
        month = F.year("d") * 12 + F.month("d")
        tests = days.crossJoin(F.broadcast(ends)).groupBy().agg(F.max(step).alias("step"), F.max(F.datediff("d", "lo") % step != 0).alias("odd"), F.max("k").alias("k"), (F.max(month) - F.min(month) + 1).alias("months"), F.countDistinct(month).alias("own"), (F.min(F.dayofmonth("d")) == F.max(F.dayofmonth("d"))).alias("same"), F.min(F.col("d") == F.last_day("d")).alias("last"))
        regular = (F.col("step") == F.floor("step")) & ~F.col("odd")
        monthly = (F.col("own") == F.col("k")) & (F.col("months") == F.col("k")) & (F.col("same") | F.col("last"))
        steps.append(tests.select(F.lit(c).alias("column"), F.when(regular, F.concat(F.col("step").cast("long").cast("string"), F.lit("d"))).when(monthly, "monthly").otherwise("irregular").alias("frequency")))
    if not steps:
        return got.withColumn("range_days", F.lit(None).cast("long")).withColumn("frequency", F.lit(None).cast("string"))
    return got.join(reduce(DataFrame.unionByName, steps), "column", "left").select("column", "n", "min", "max", F.datediff("max", "min").cast("long").alias("range_days"), "frequency")


def size_estimate(df: DataFrame) -> DataFrame:
    """(bytes, rows): one row with what the optimiser expects of ``df``, without reading it; rows are null where it can't tell."""
    s = df._jdf.queryExecution().optimizedPlan().stats()
    rows = s.rowCount()
    return df.sparkSession.createDataFrame([(min(int(str(s.sizeInBytes())), (1 << 63) - 1), int(str(rows.get())) if rows.isDefined() else None)], "bytes long, rows long")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, nulls, non_null, null_pct, distinct, min, max, mean, std, min_length, max_length) of all comparable columns."""
    t = Table(canonical(df))
    kinds = {"nulls": "long", "non_null": "long", "distinct": "long", "min": "double", "max": "double", "mean": "double", "std": "double", "min_length": "long", "max_length": "long"}
    none = F.max(F.lit(None).cast("double"))
    parts = {}
    for c in t.comparable:
        x, number, text = t.c(c), t.c(c).cast("double") if c in t.numeric else None, c in t.text
        parts[c] = {"nulls": F.count_if(x.isNull()), "non_null": F.count(x), "distinct": F.countDistinct(x)} | {k: f(number) if number is not None else none for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))} | {"min_length": F.min(F.length(x)) if text else none, "max_length": F.max(F.length(x)) if text else none}
    got = _long(t.df.drop(ROW_ID), parts, kinds)
    kind = F.create_map(*(v for c, k in t.df.dtypes for v in (F.lit(c), F.lit(k))))
    return got.select("column", kind[F.col("column")].alias("dtype"), "nulls", "non_null", F.round(F.try_divide(F.col("nulls") * 100.0, F.col("nulls") + F.col("non_null")), 2).alias("null_pct"), "distinct", *("min", "max"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min_length", "max_length")
