"""Continuous checks with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.table import ROW_ID, Table, canonical
from lodestar.plans.model import Finding, Rule
from lodestar.plans.registry import resolve
from lodestar.plans.run import Report, run_checks


def volume_windows(events: DataFrame, time: str, width: str = "1 hour", by: list[str] | None = None, *more: Column, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, by..., n, more...) in tumbling windows; batch or stream, late rows dropped behind the watermark."""
    rows = events.withWatermark(time, watermark) if watermark else events
    out = rows.groupBy(F.window(time, width), *(by or [])).agg(F.count("*").alias("n"), *more)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def latency_windows(events: DataFrame, time: str, arrived: str, width: str = "1 hour", max_hours: float = 24, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, n, late, max_latency_h) of rows by their event time."""
    hours = F.abs(F.timestamp_diff("MICROSECOND", F.col(time), F.col(arrived)) / F.lit(3.6e9))
    return volume_windows(events, time, width, None, F.count_if(hours > max_hours).alias("late"), F.round(F.max(hours), 2).alias("max_latency_h"), watermark=watermark)


def check_stream(stream: DataFrame, rules: str, sink: Callable[[Report, int], None], checkpoint: str, configs: dict | None = None, once: bool = True) -> StreamingQuery:
    """Runs the rules over each micro-batch; once: over what has arrived, then ends."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            sink(run_checks(rows, rules, configs), number)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: The value that a plain count is taken to have when a rule is asked ahead what it will want next.
GUESS = 1000


def _in_state(column: Any) -> bool:
    return isinstance(column, Column) and not any(w in str(column).lower() for w in ("percentile", "collect_"))


def _asked_ahead(table: Table, rules: list[tuple[Rule, dict[str, Any]]]) -> dict[str, Column]:
    """What rules will ask, round by round, by the text of the expressions, equal ones once.

    Rounds after the first are found by answering with a guess, which is right for what hangs
    on columns and arguments alone; an ask that turns out otherwise can't be answered later.
    """
    columns: dict[str, Column] = {}
    for rule, config in rules:
        check = rule.check(table, **config)
        try:
            ask = next(check)
            while all(map(_in_state, ask.values())):
                columns |= {str(c): columns.get(str(c), c) for c in ask.values()}
                ask = check.send(dict.fromkeys(ask, GUESS))
        except Exception:  # noqa: BLE001  ended, or the guess didn't fit
            pass
        finally:
            check.close()
    return columns


def _judged(table: Table, rule: Rule, config: dict[str, Any], values: dict[str, Any]) -> Finding:
    """A rule's finding from the values that are kept."""
    check = rule.check(table, **config)
    try:
        ask = next(check)
        while True:
            if odd := [label for label, c in ask.items() if str(c) not in values]:
                found = Finding(False, 0, 0, 0.0, [{"error": f"not kept in state: {', '.join(odd)}"[:500]}], errored=True)
                break
            ask = check.send({label: values[str(c)] for label, c in ask.items()})
    except StopIteration as done:
        found = done.value
    except Exception as problem:  # noqa: BLE001  one rule's problem is its own finding
        found = Finding(False, 0, 0, 0.0, [{"error": str(problem)[:500]}], errored=True)
    finally:
        check.close()
    found.rule_name, found.description, found.severity = rule.name, rule.description, found.severity or config.get("severity") or rule.severity
    found.failures = None  # the rows are gone; ``check_stream`` has those of a batch
    return found


def monitor_stream(stream: DataFrame, rules: str | Iterable[str], sink: Callable[[dict[tuple, Report], int], None], checkpoint: str, configs: dict[str, dict[str, Any]] | None = None, by: list[str] | None = None, window: tuple[str, str] | None = None, watermark: str | None = None, as_of: str | None = None, once: bool = True) -> StreamingQuery:
    """Judges a stream by the rules over *all* rows so far, not batch by batch.

    Rules ask for aggregates (counts, sums, extremes, moments), which Spark keeps in its
    state store and brings up to date with each micro-batch, surviving restarts by
    ``checkpoint``; the rules then make their findings of them as they do for a table.
    sink gets a report by group: ``()`` without groups; else the values of ``by``, after the
    start of the ``window`` (time column, width) if there is one.  Without groups every batch
    has the report; with groups, those that the batch touched.  With a ``watermark`` the state
    of windows behind it is dropped, and rows that late are left out.  Rules that need distinct
    values or quantiles, or whose second round hangs on what the first has found (such as the
    format of dates in text other than ISO), can't be kept so and are errored findings.
    """
    by, configs = by or [], configs or {}
    rows = stream.withWatermark(window[0], watermark) if window and watermark else stream
    like = stream.sparkSession.createDataFrame([], stream.schema).drop(*by)  # rules look at columns, not at rows
    table = Table(canonical(like), as_of)
    chosen = [(r, configs.get(r.key, {})) for r in resolve(rules)]
    columns = _asked_ahead(table, chosen)
    texts = list(columns)
    values = [columns[t].alias(f"v{i}") for i, t in enumerate(texts)] or [F.count("*").alias("v0")]
    whole = canonical(rows, rows.columns[0]).drop(ROW_ID)
    keys = [*([F.window(*window).alias("_window")] if window else []), *(F.col(f"`{c}`") for c in by)]
    kept = (whole.groupBy(*keys) if keys else whole.groupBy()).agg(*values)

    def batch(found: DataFrame, number: int) -> None:
        reports = {}
        for r in found.collect():  # a row a group
            key = tuple([r["_window"]["start"]] if window else []) + tuple(r[c] for c in by)
            own = {t: r[f"v{i}"] for i, t in enumerate(texts)}
            reports[key] = Report(stream.sparkSession, [_judged(table, *c, own) for c in chosen])
        sink(reports, number)

    writer = kept.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
