"""Dates: validity, range, order, freshness, latency."""

from __future__ import annotations

from collections.abc import Generator
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.table import Table
from lodestar.plans.model import Ask, Check, Finding, finding, percent
from lodestar.plans.registry import rule

#: Formats of dates in text, in the order of preference, and the shape of text that can follow them.
FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d\d-\d\d$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$",
    "dd/MM/yyyy": r"^\d\d/\d\d/\d{4}$",
    "MM/dd/yyyy": r"^\d\d/\d\d/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
_ORDER = list(FORMATS)


def parsed(c: Column, pattern: str) -> Column:
    """The timestamp, or null; only text of the right shape is parsed, as a failed parse is dear."""
    return F.when(c.rlike(FORMATS[pattern]), F.try_to_timestamp(c, F.lit(pattern)))


def dates(t: Table, only: list[str] | None = None) -> Generator[Ask, dict, dict[str, tuple[Column, int, int]]]:
    """Timestamp, values and parseable values of each date column.

    Date columns are timestamps, and text of which the format that fits most values fits
    at least three and half of the rows.
    """
    text = [c for c in t.text if only is None or c in only]
    ready = [c for c in t.temporal if only is None or c in only]
    ask = {"rows": F.count("*")} | {f"v:{c}": F.count(t.c(c)) for c in text + ready} | {f"{f}:{c}": F.count(parsed(t.c(c), f)) for c in text for f in FORMATS}
    got = yield ask
    out = {c: (t.c(c).cast("timestamp"), got[f"v:{c}"], got[f"v:{c}"]) for c in ready}
    for c in text:
        best = max(FORMATS, key=lambda f: (got[f"{f}:{c}"], -_ORDER.index(f)))
        n = got[f"{best}:{c}"]
        if n >= max(3, 0.5 * got["rows"]):
            out[c] = (parsed(t.c(c), best), got[f"v:{c}"], n)
    return {c: out[c] for c in t.columns if c in out}


@rule("invalid_dates", "invalid_date_check", "Values of date columns that are no dates")
def invalid_dates(t: Table, **_) -> Check:
    found = yield from dates(t)
    own = {c: x for c, x in found.items() if x[1] >= 2}
    details = [{"column": c, "failed": v - n, "total": v, "pct": percent(v - n, v)} for c, (_, v, n) in own.items() if v > n]
    parts = [(c, t.c(c).isNotNull() & x[0].isNull(), t.c(c)) for c, x in own.items()]
    return finding(sum(v for _, v, _ in own.values()), sum(d["failed"] for d in details), details, t.failures("invalid_date_check", parts), "Correct the values that are no dates")


@rule("date_range", "date_range_check", "Dates before a year or after now")
def date_range(t: Table, min_year: int = 1900, max_date: str | None = None, **_) -> Check:
    found = yield from dates(t)
    high = F.lit(max_date).cast("timestamp") if max_date else t.now()
    low = F.lit(f"{min_year:04d}-01-01").cast("timestamp")
    got = (yield {k: v for c, (d, _, _) in found.items() for k, v in ((f"b:{c}", F.count_if(d < low)), (f"a:{c}", F.count_if(d > high)))}) if found else {}
    details = [{"column": c, "before_min": got[f"b:{c}"], "after_max": got[f"a:{c}"], "total": n} for c, (_, _, n) in found.items() if got[f"b:{c}"] + got[f"a:{c}"]]
    parts = [(c, (d < low) | (d > high), t.c(c)) for c, (d, _, _) in found.items()]
    return finding(sum(n for _, _, n in found.values()), sum(d["before_min"] + d["after_max"] for d in details), details, t.failures("date_range_check", parts), "Correct the dates out of range")


@rule("date_inconsistency", "date_inconsistency_check", "Pairs of dates that are mostly in the wrong order")
def date_inconsistency(t: Table, **_) -> Check:
    """A pair (earlier column first) counts only if its order is wrong in over half of the rows that have both."""
    found = yield from dates(t)
    pairs = list(combinations(found, 2))
    ask = {}
    for a, b in pairs:
        x, y = found[a][0], found[b][0]
        ask |= {f"n:{a}|{b}": F.count_if(x.isNotNull() & y.isNotNull()), f"f:{a}|{b}": F.count_if(x > y)}
    got = (yield ask) if ask else {}
    details, parts = [], []
    for a, b in pairs:
        n, bad = got[f"n:{a}|{b}"], got[f"f:{a}|{b}"]
        if n and bad > 0.5 * n:
            details.append({"first": a, "second": b, "failed": bad, "total": n})
            parts.append((f"{a},{b}", found[a][0] > found[b][0], F.concat_ws(" > ", t.c(a).cast("string"), t.c(b).cast("string"))))
    return finding(sum(got[f"n:{a}|{b}"] for a, b in pairs), sum(d["failed"] for d in details), details, t.failures("date_inconsistency_check", parts), "Check which of the dates comes first")


@rule("freshness", "freshness_check", "Dates that are too old", severity="warning")
def freshness(t: Table, max_days_old: int = 365, **_) -> Check:
    found = yield from dates(t)
    least = t.now() - F.make_dt_interval(F.lit(max_days_old))
    got = (yield {k: v for c, (d, _, _) in found.items() for k, v in ((f"f:{c}", F.count_if(d < least)), (f"lo:{c}", F.min(d)), (f"hi:{c}", F.max(d)))}) if found else {}
    details = [{"column": c, "failed": got[f"f:{c}"], "total": n, "oldest": got[f"lo:{c}"], "newest": got[f"hi:{c}"]} for c, (_, _, n) in found.items() if got[f"f:{c}"]]
    return finding(sum(n for _, _, n in found.values()), sum(d["failed"] for d in details), details, t.failures("freshness_check", [(c, d < least, t.c(c)) for c, (d, _, _) in found.items()]), "Refresh the data")


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9))


@rule("latency", "latency_check", "Rows that arrive too long after their event", severity="warning")
def latency(t: Table, max_latency_hours: float = 24, event_col: str = "event_timestamp", ingest_col: str = "ingested_at", **_) -> Check:
    if event_col not in t.columns or ingest_col not in t.columns:
        return Finding(True, 0, 0, 0.0, [{"note": "columns not found"}])
    found = yield from dates(t, [event_col, ingest_col])
    if len(found) < 2:
        return Finding(True, 0, 0, 0.0, [{"note": "no pairs of dates"}])
    late = hours_between(found[event_col][0], found[ingest_col][0])
    got = yield {"n": F.count(late), "f": F.count_if(late > max_latency_hours), "max": F.max(late), "avg": F.avg(late)}
    if not got["n"]:
        return Finding(True, 0, 0, 0.0, [{"note": "no pairs of dates"}])
    details = [{"event_col": event_col, "ingest_col": ingest_col, "failed": got["f"], "total": got["n"], "max_latency_h": round(got["max"], 2), "avg_latency_h": round(got["avg"], 2)}]
    return finding(got["n"], got["f"], details, t.failures("latency_check", [(f"{event_col},{ingest_col}", late > max_latency_hours, late)]), "Look for delays in the ingest")
