"""Exact quantiles of many columns by selection: histograms that narrow the values of each wanted rank.

No values are sorted and none are gathered.  The first pass counts each column's values in
bins of their own size (powers of two in ``FINE`` parts, either sign), so that no spread of
values is too wide; the bin of a rank gives the range of the next pass, from its least to its
greatest value, in ``BINS`` equal parts.  A range of few values is counted value by value.
A pass is one job over all columns and ranks, adds up in the tasks before anything is
shuffled, and returns a bounded histogram; its number hangs on the logarithm of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a power of two in the first pass, of a range in later ones, and values of a range that are counted one by one.
FINE, BINS, FEW = 64, 1024, 4096


@dataclass(frozen=True)
class Quantiles:
    """An ask for the quantiles of a numeric column, nulls left out, between neighbours by interpolation."""

    column: Column
    shares: tuple[float, ...]


def _first_bin(x: Column) -> Column:
    """Ordered bins of numbers of any size: by sign, exponent and the leading bits below it."""
    size = F.abs(x)
    exponent = F.floor(F.least(F.greatest(F.log2(size), F.lit(-1074.0)), F.lit(1024.0))).cast("double")
    part = F.greatest(F.least(F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * FINE).cast("double"), F.lit(FINE - 1.0)), F.lit(0.0))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * ((exponent + 1075) * FINE + part + 1))


@dataclass
class _Range:
    """Values from low to high of one column, ``count`` of them, ``before`` smaller ones."""

    column: int
    low: float
    high: float
    before: int
    count: int


def _histogram(df: DataFrame, columns: list[Column], ranges: list[_Range] | None) -> dict[int, list]:
    """(bin, count, least, greatest) in order, by column in the first pass and by range after it."""
    cells = []
    for i, x in enumerate(columns):
        if ranges is None:
            cells.append(F.struct(F.lit(i).alias("of"), _first_bin(x).alias("bin"), x.alias("x")))
            continue
        own = [(k, r) for k, r in enumerate(ranges) if r.column == i]
        if not own:
            continue
        of, place = F, F
        for k, r in own:
            inside = (x >= r.low) & (x <= r.high)
            at = x if r.count <= FEW else F.floor((x - r.low) / F.lit(r.high - r.low) * BINS).cast("double")
            of, place = of.when(inside, k), place.when(inside, at)
        cells.append(F.struct(of.alias("of"), place.alias("bin"), x.alias("x")))
    rows = df.select(F.inline(F.filter(F.array(*cells), lambda c: c["of"].isNotNull() & c["bin"].isNotNull())))
    found: dict[int, list] = {}
    for r in rows.groupBy("of", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
        found.setdefault(r["of"], []).append((r["bin"], r["n"], r["low"], r["high"]))
    return {k: sorted(v) for k, v in found.items()}


def exact_quantiles(df: DataFrame, asks: list[Quantiles]) -> list[list[float] | None]:
    """The quantiles of each ask, as Spark's exact ``percentile`` gives them; None for columns without values."""
    if not asks:
        return []
    columns = [a.column.cast("double") for a in asks]
    first = _histogram(df, columns, None)
    counts = [sum(b[1] for b in first.get(i, [])) for i in range(len(asks))]
    open_ranks = [sorted({r for s in a.shares for p in [s * (n - 1)] for r in (int(p), min(int(p) + 1, n - 1))}) if n else [] for a, n in zip(asks, counts, strict=True)]
    values: list[dict[int, float]] = [{} for _ in asks]

    def settle(i: int, bins: list, before: int, ranks: list[int]) -> list[tuple[_Range, list[int]]]:
        """Ranks whose bin holds one value are done; the others' bins are the next ranges."""
        out = []
        for _, n, low, high in bins:
            own = [r for r in ranks if before <= r < before + n]
            if own and low == high:
                values[i].update(dict.fromkeys(own, low))
            elif own:
                out.append((_Range(i, low, high, before, n), own))
            before += n
        return out

    todo = [x for i in range(len(asks)) for x in settle(i, first.get(i, []), 0, open_ranks[i])]
    while todo:
        found = _histogram(df, columns, [r for r, _ in todo])
        todo = [x for k, (r, ranks) in enumerate(todo) for x in settle(r.column, found[k], r.before, ranks)]
    out: list[list[float] | None] = []
    for a, n, own in zip(asks, counts, values, strict=True):
        out.append([_between(own, s * (n - 1), n) for s in a.shares] if n else None)
    return out


def _between(values: dict[int, float], place: float, n: int) -> float:
    low = int(place)
    a, b = values[low], values[min(low + 1, n - 1)]
    return a if a == b or place == low else (low + 1 - place) * a + (place - low) * b
