"""Near-duplicate documents by fast similarity sketching.

Each document's set of word shingles is placed in ``COORDINATES`` bins: in round i a
hash deals every element to one bin with a value in [i, i+1), and later rounds only fill
bins that are still empty; rounds from ``COORDINATES`` on put the elements into one given
bin each, so every coordinate fills.  Equal sets are one class.  Bands of four
coordinates form buckets of classes; links are confirmed on the full sets.

A bucket never yields all its pairs.  Buckets of the same members count once.  First each
member is compared with the bucket's smallest document.  Then the members that aren't in that
document's component so far are compared with all members of other components: the bucket
is cut into blocks of bounded size, two blocks meet in one group of rows, and what comes out
is one link for each two components at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.graph import components
from lodestar.llm.common import chunks, give_back, lists, saved, utf8
from lodestar.llm.windows import mix
from lodestar.llm.words import shingles, words_of

#: 30 bands of 4 miss a pair of similarity 0.8 once in 7 million.
COORDINATES, BAND = 120, 4
#: Members of a block of a bucket, about, and shingles of all of them, about.
BLOCK, BLOCK_ITEMS = 256, 1 << 20
#: Columns of the table of shared shingles that is multiplied at once.
COLUMNS = 1 << 13
_K = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(2 * COORDINATES + 1, dtype=np.uint64) * _K
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    w = words_of(data, offsets, lower=True)
    f = w.first.tolist()
    return [np.unique(shingles(w.hashes[a:b], width)) for a, b in zip(f, f[1:], strict=False)]


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` values for each set; rows of empty sets stay unfilled."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, _EMPTY)
    for i in range(2 * t):
        if not len(x):
            break
        y = mix(x + _SALTS[i + 1])
        bins = (y >> np.uint64(32)) % np.uint64(t) if i < t else np.uint64(i - t)
        np.minimum.at(out, row * t + np.asarray(bins, np.int64), (np.uint64(i) << np.uint64(56)) | (y & np.uint64((1 << 56) - 1)))
        open_rows = (out.reshape(-1, t) == _EMPTY).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            x, row = x[keep], row[keep]
    return out.reshape(-1, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, different from band to band."""
    bands = sketches.shape[1] // BAND
    parts = sketches[:, : bands * BAND].reshape(-1, bands, BAND)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        keys = mix(keys * _K + parts[:, :, k])
    return keys


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(*utf8(b.column("text")), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = [np.array([mix(s + c).sum(dtype=np.uint64) for s in sets], np.uint64) for c in _SALTS[[77, 99]]]
            keys = band_keys(sketch(sets))
            full = sizes > 0
            counts = np.where(full, keys.shape[1], 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), lists(keys[full].reshape(-1).view(np.int64), counts, pa.int64())], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(*utf8(b.column("text")), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), lists(np.concatenate(sets).view(np.int64), sizes, pa.int64())], ["doc_id", "n", "items"])

    return run


def _similar(a: str, b: str, na: str, nb: str, percent: int):
    common = F.size(F.array_intersect(a, b)).cast("long")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * common >= percent * (F.col(na) + F.col(nb) - common))


def _common(values: np.ndarray, rows: np.ndarray, k: int, wanted: np.ndarray) -> np.ndarray:
    """How many values each wanted one of ``k`` sets shares with each set; values: all sets, joined, rows: whose they are."""
    order = np.argsort(values, kind="stable")
    v, r = values[order], rows[order]
    new = np.append(True, v[1:] != v[:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(v)))
    column = np.cumsum(n > 1)[np.cumsum(new) - 1] - 1  # of values in several sets
    shared = np.repeat(n > 1, n)
    column, r = column[shared], r[shared]
    out = np.zeros((len(wanted), k), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        table = np.zeros((k, COLUMNS if b < len(r) else int(column[-1]) + 1 - i * COLUMNS), np.float32)
        table[r[a:b], column[a:b] - i * COLUMNS] = 1
        out += table[wanted] @ table.T
    return out


def _cell_links(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components with a link, from whole groups of equal key and cell."""
    key, cell, doc, part, n, x, y, other = (np.asarray(t.column(c)) for c in ("key", "cell", "doc_id", "part", "n", "x", "y", "other"))
    items = t.column("items").combine_chunks()
    values, offsets = np.asarray(items.values), np.asarray(items.offsets).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True]))).tolist()
    found = []
    for a, b in zip(edges, edges[1:], strict=False):
        at = np.flatnonzero(x[a:b])
        if not len(at) or not y[a:b].any():
            continue
        own = values[offsets[a] : offsets[b]]
        common = _common(own, np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), b - a, at).astype(np.int64)
        p, q = part[a:b][at], part[a:b]
        linked = 100 * common >= percent * (n[a:b][at][:, None] + n[a:b] - common)
        linked &= (p[:, None] != q) & y[a:b] & (~other[a:b] | (doc[a:b][at][:, None] < doc[a:b]))
        i, j = np.nonzero(linked)
        if len(i):
            found.append(np.unique(np.stack([p[i], q[j]], axis=1), axis=0))
    got = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return got[:, 0], got[:, 1]


def _cells(percent: int):
    """Rows sorted by (key, cell) to the links between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            u, v = _cell_links(t, percent)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            rest = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not rest.num_rows:
                continue
            key, cell = np.asarray(rest.column("key")), np.asarray(rest.column("cell"))
            differ = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            edge = int(differ[-1]) + 1 if len(differ) else 0
            held = rest.slice(edge)
            if edge:
                yield out(rest.slice(0, edge))
        if held is not None and held.num_rows:
            yield out(held)
        give_back()

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Texts are linked when the Jaccard similarity of their sets of ``words``-word shingles
    is ``percent`` % or more; a text with fewer words is one shingle.  component_id is the
    smallest doc_id reachable, kept marks doc_id = component_id.  Null and blank texts
    have empty sets and link with nothing.  Rows that share a doc_id are one document, which
    is linked with whatever one of its texts is linked with.  A null doc_id links with
    nothing: its component_id is null and it is kept.  Texts of any length are compared whole; a similarity of just ``percent`` % links.
    Other columns are ignored; an empty table gives an empty result.  ``block`` only sets how
    the work on large buckets is cut.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(texts.mapInArrow(_sketched(words), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    first = real.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["s1", "s2", "doc_id"])
    keyed = first.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("who")).where("center <> last")
    buckets = buckets.groupBy("center", "last", "size", "who").agg(F.min("key").alias("key")).select("key", "center")
    members = saved(keyed.join(buckets, "key"), "buckets")
    stars = members.where("doc_id <> center").select(F.col("center").alias("u"), F.col("doc_id").alias("v")).distinct()
    # sides that grow with the input are shuffled at every size, so that small inputs behave like large ones
    wanted = members.select("doc_id").distinct().hint("merge")
    sets = saved(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_full_sets(words), "doc_id long, n long, items array<long>"), "sets")
    at_u, at_v = (sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("items").alias(f"i{k}")).hint("merge") for k in "uv")
    links = stars.join(at_v, "v").join(at_u, "u").where(_similar("iu", "iv", "nu", "nv", percent)).select("u", "v")
    # a document of several texts is one node with the classes of all of them
    several = real.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("doc_id")
    own = real.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct().join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = saved(links.union(own), "links")
    parts = components(links)
    named = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    named = named.join(parts.select(F.col("node").alias("center"), F.col("component").alias("center_part")), "center", "left").withColumn("other", F.col("part") != F.coalesce("center_part", "center"))
    blocks = lambda size, items: F.greatest(F.ceil(size / block), F.ceil(items / BLOCK_ITEMS))
    others = F.when(F.col("other"), F.col("n"))
    mixed = named.groupBy("key").agg(blocks(F.count(others), F.sum(others)).alias("xs"), blocks(F.count("*"), F.sum("n")).alias("ys")).where("xs > 0")
    # the others of block i meet all of block j in cell (i, j)
    rest = named.join(mixed, "key").withColumns({"i": F.pmod(F.xxhash64("doc_id"), F.col("xs")), "j": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("ys"))})
    as_y = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: i * F.col("ys") + F.col("j"))
    as_x = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.col("i") * F.col("ys") + j)).otherwise(F.array().cast("array<bigint>"))
    rest = rest.select("key", "doc_id", "part", "other", "i", "j", "ys", F.explode(F.array_union(as_y, as_x)).alias("cell"))
    rest = rest.select("key", "cell", "doc_id", "part", "other", (F.col("other") & (F.floor(F.col("cell") / F.col("ys")) == F.col("i"))).alias("x"), (F.col("cell") % F.col("ys") == F.col("j")).alias("y"))
    cells = rest.join(sets.hint("merge"), "doc_id").repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "doc_id", "part", "other", "x", "y", "n", "items")
    more = saved(cells.mapInArrow(_cells(percent), "u long, v long").distinct(), "more_links")
    whole = components(more.union(parts.select(F.col("component").alias("u"), F.col("node").alias("v"))))
    named_classes = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("found"))
    out = rows.join(named_classes, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
