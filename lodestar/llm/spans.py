"""Spans found in texts, as counts, digests and strings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import chunks

#: kind, start, end (code points, end exclusive).
Span = tuple[str, int, int]


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def span_table(docs: DataFrame, make: Callable[[], Callable[[str], list[Span]]], base: list[str], extra: list[str], by_start: bool) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans) for every row of ``docs``.

    ``make`` gives a function from a text to its spans, built once in each worker.  Spans
    are ordered by kind, then start, or by start, then kind.
    """
    rank = {k: i for i, k in enumerate([*base, *extra])}
    order = (lambda s: (s[1], rank[s[0]], s[2])) if by_start else (lambda s: (rank[s[0]], s[1], s[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for b in chunks(batches):
            found = [sorted(find(t or ""), key=order) for t in b.column("text").to_pylist()]
            basic = [[s for s in f if s[0] in base] for f in found]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in [*base, *extra]]
            digests = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in basic], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts[: len(base)], digests, pa.array([joined(f) for f in found], pa.string()), *counts[len(base) :]], names)

    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", *(f"n_{k}" for k in extra)]
    kinds = ["long"] * (1 + len(base)) + ["string", "string"] + ["long"] * len(extra)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
