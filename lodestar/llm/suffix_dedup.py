"""Removal of byte strings that an earlier document already has.

A byte goes if some ``SPAN``-byte string that covers it also starts in a document with a
smaller id.  Every window of ``SPAN`` bytes owns one anchor, chosen by content alone
(see :mod:`lodestar.llm.windows`); neighbouring windows of one anchor form a segment, and
equal windows always lie in segments of equal anchors.  So

1. anchors meet, and those of a single document leave: most of the corpus;
2. the segments of the others meet by anchor and content: where whole segments are equal,
   all windows of the later document repeat;
3. segments that share an anchor but differ meet with their bytes, and their windows are
   compared in their task; those of an anchor of very many segments are opened into single
   windows instead, which meet by content and need no memory;
4. what repeats goes back to the texts, which were shuffled once, compressed.

Copies of a whole text are one text from the start.  The README says why the construction
of one collection-wide suffix order by one symbol per document and round isn't used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.bwt import suffix_classes
from lodestar.llm.common import chunks, utf8
from lodestar.llm.windows import gram_hash, mix, sliding_min
from lodestar.llm.words import powers

SPAN, GRAM, LONGEST = 50, 20, 63
#: Segments of one anchor up to which they are compared in one task.
TOGETHER = 4096
#: Segments of one sorted collection, about; ranges of bytes that a window has before its anchor.
COLLECTION, SIDES = 1536, ((0, 4), (5, 9), (10, 14), (15, 19), (20, 24), (25, SPAN - GRAM))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Low bits of a text's hash that go with a place; high bits that go with a segment's number.
_TAG, _HIGH = (1 << 26) - 1, 26
#: Marks a segment's number: another text has its anchor too.
_SHARED = 1 << 25
#: Marks of places: the whole segment repeats; to be opened.
_WHOLE, _OPEN = -(1 << 63), 1 << 62


class _Strings:
    """Hashes of any substrings of one text, in constant time each."""

    def __init__(self, data: np.ndarray, which: int):
        self.n, self.which = len(data), which
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers(f"string{which}", _BASES[which], self.n), out=self.total[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = powers(f"unstring{self.which}", _INVERSES[self.which], self.n + 1)[starts]
        return mix((self.total[ends] - self.total[starts]) * back + (ends - starts).astype(np.uint64))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each segment of a text."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(mix(gram_hash(data, GRAM, _BASES[0])), SPAN - GRAM + 1)
    new = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate(([0], new))
    counts = np.diff(np.append(starts, len(low)))
    if counts.max() > LONGEST:  # runs of one repeated character; cut, as a count has six bits
        parts = -(-counts // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        counts = np.minimum(LONGEST, np.repeat(counts, parts) - LONGEST * within)
        starts = np.repeat(starts, parts) + LONGEST * within
    return starts, counts, low[starts]


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in chunks(batches):
        data, offsets = utf8(b.column("text"))
        offs = offsets.tolist()
        packed = [press.compress(data[i:j]) for i, j in zip(offs, offs[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array(packed, pa.binary())], ["doc_id", "h1", "h2", "zip"])


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    return (np.frombuffer(press.decompress(x), np.uint8) for x in batch.column("zip").to_pylist())


def _scattered(values: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly."""
    return mix(values.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor of each segment, with its number and bits of the text's hash.

    Of an anchor that several texts of a batch have, two rows of different texts speak for
    all; the others are marked as shared already and dealt out evenly.
    """
    for b in batches:
        cols: list[list[np.ndarray]] = [[], []]
        for data, d, h in zip(_texts(b), b.column("d").to_pylist(), b.column("h1").to_pylist(), strict=True):
            if d is None or len(data) < SPAN:
                continue
            anchors = segments(data)[2].view(np.int64)
            if len(anchors) >= _SHARED:
                raise ValueError(f"document {d} has {len(anchors)} segments, too many to number")
            cols[0].append(anchors)
            cols[1].append(np.arange(len(anchors)) | (h >> _HIGH << _HIGH))
        if not cols[0]:
            continue
        anchor, number = (np.concatenate(c) for c in cols)
        order = np.argsort(anchor, kind="stable")
        by_anchor, text = anchor[order], number[order] >> _HIGH
        heads = np.flatnonzero(np.append(True, by_anchor[1:] != by_anchor[:-1]))
        tails = np.append(heads[1:], len(order)) - 1
        several = np.repeat(text[heads] != text[tails], tails - heads + 1)
        several[heads] = False
        several[tails] = False
        known = np.sort(order[several])  # rows stay in the order of the texts, which packs well
        number[known] |= _SHARED
        anchor[known] = _scattered(number[known])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(number)], ["anchor", "number"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, content and place of the numbered segments.

    A segment that a smaller id of the batch has too is marked as repeated already and
    dealt out evenly; the smallest id speaks for it.
    """
    for b in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        for data, d, tag, numbers in zip(_texts(b), *(b.column(c).to_pylist() for c in ("d", "tag", "numbers")), strict=True):
            if d is None or len(data) < SPAN:
                continue
            starts, counts, anchors = segments(data)
            own = np.array(numbers, np.int64)
            own = np.sort(own[own < len(starts)])  # texts with the same high bits share their numbers
            starts, counts = starts[own], counts[own]
            content = _Strings(data, 1).hash(starts, starts + counts + SPAN - 1)
            for c, x in zip(cols, (anchors[own].view(np.int64), content.view(np.int64), np.full(len(own), d, np.int64), starts << 32 | counts << 26 | tag), strict=True):
                c.append(x)
        if not cols[0]:
            continue
        anchor, content, d, place = (np.concatenate(c) for c in cols)
        order = np.lexsort((d, content, anchor))
        new = np.ones(len(d), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
        least = d[order][np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
        later = np.sort(order[d[order] > least])
        place[later] |= _WHOLE
        anchor[later] = content[later] = _scattered(place[later] ^ d[later])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(d), pa.array(place)], ["anchor", "content", "d", "place"])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each start and the ``count`` - 1 numbers after it."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of packed places."""
    x = place & (_OPEN - 1)
    return x >> 32, (x >> 26) & LONGEST


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their bytes, by anchor; those marked to be opened as single windows, by content."""
    names = ["key", "key2", "d", "place", "bytes"]
    for b in batches:
        few: list[list] = [[], [], [], []]
        many: list[list[np.ndarray]] = [[], [], [], []]
        for data, d, tag, spots in zip(_texts(b), *(b.column(c).to_pylist() for c in ("d", "tag", "spots")), strict=True):
            place = np.array(spots, np.int64)
            place = np.sort(place[place >= 0])
            if not len(place):
                continue
            starts, counts = _parts(place)
            raw, own = data.tobytes(), place < _OPEN
            for i, j in zip(starts[own].tolist(), counts[own].tolist(), strict=True):
                few[3].append(raw[i : i + j + SPAN - 1])
            if own.any():
                low = sliding_min(mix(gram_hash(data, GRAM, _BASES[0])), SPAN - GRAM + 1)
                for c, x in zip(few, (low[starts[own]].view(np.int64), np.full(own.sum(), d, np.int64), place[own]), strict=False):
                    c.append(x)
            if not own.all():
                at = _spread(starts[~own], counts[~own])
                for c, x in zip(many, (*(_Strings(data, k).hash(at, at + SPAN).view(np.int64) for k in (0, 1)), np.full(len(at), d, np.int64), at << 32 | 1 << 26 | tag), strict=True):
                    c.append(x)
        if few[0]:
            key, d, place = (np.concatenate(c) for c in few[:3])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros_like(key)), pa.array(d), pa.array(place), pa.array(few[3], pa.binary())], names)
        if many[0]:
            cols = [np.concatenate(c) for c in many]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(cols[0]), pa.binary())], names)


def _cuts(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, d: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each segment that another document's segment may have too; last is -1 where there is none.

    A common window has the anchor at one place; by that place, windows fall into the ranges
    of SIDES, and all windows of a range hold the same bytes around the anchor.
    """
    grams = mix(gram_hash(data, GRAM, _BASES[0]))
    seg = np.repeat(np.arange(len(key)), np.diff(offsets))[: len(grams)]
    place = np.flatnonzero(grams == key.view(np.uint64)[seg])
    place = place[place + GRAM <= offsets[seg[place] + 1]]
    owner, first = np.unique(seg[place], return_index=True)
    anchor = place[first]
    low, high = counts.copy(), np.full(len(key), -1)
    strings = _Strings(data, 0)
    for least, most in SIDES:  # bytes of a window before its anchor
        one = np.maximum(anchor - offsets[owner] - most, 0)
        two = np.minimum(anchor - offsets[owner] - least, counts[owner] - 1)
        fits = one <= two
        if not fits.any():
            continue
        own, one, two = owner[fits], one[fits], two[fits]
        side = strings.hash(anchor[fits] - least, anchor[fits] + SPAN - most)
        order = np.lexsort((d[own], side))
        s, who = side[order], d[own][order]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        tails = np.append(heads[1:], len(s)) - 1
        met = order[np.repeat(who[heads] != who[tails], tails - heads + 1)]
        low[own[met]] = np.minimum(low[own[met]], one[met])
        high[own[met]] = np.maximum(high[own[met]], two[met])
    twice = np.bincount(seg[place], minlength=len(key)) != 1  # the anchor's place isn't plain; all is left to the comparison
    whole = np.isin(key, key[twice])
    low[whole], high[whole] = 0, counts[whole] - 1
    return low, high


def _later(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(d, place) of the runs of windows in whole groups of segments that a smaller d has too.

    Segments are cut to the windows that can match, and of equal ones the smallest d speaks
    for all.  Their collections are sorted by suffixes, column by column; neighbours with
    SPAN symbols in common are equal windows.
    """
    key, d, place = (np.asarray(table.column(c)) for c in ("key", "d", "place"))
    data, offsets = utf8_bytes(table.column("bytes"))
    starts, counts = _parts(place)
    low, high = _cuts(data, offsets, key, d, counts)
    keep = np.flatnonzero(high >= 0)
    key, d = key[keep], d[keep]
    begins, counts = offsets[keep] + low[keep], (high - low)[keep] + 1
    place = starts[keep] + low[keep] << 32 | counts << 26 | place[keep] & _TAG
    h1, h2 = (_Strings(data, k).hash(begins, begins + counts + SPAN - 1) for k in (0, 1))
    order = np.lexsort((d, h2, h1, key))
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    least = np.empty_like(d)
    least[order] = d[order][np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    copies = d > least
    found = [(d[copies], place[copies])]
    keep = np.flatnonzero(~copies)
    if not len(keep):
        return found[0]
    heads = np.append(True, np.diff(key[keep]) != 0)
    group, longest = np.cumsum(heads) - 1, np.maximum.reduceat(counts[keep], np.flatnonzero(heads))
    keep = keep[np.lexsort((group, longest[group]))]  # a collection has as many rounds as its longest segment has bytes
    key, d, place, begins, sizes = key[keep], d[keep], place[keep], begins[keep], counts[keep] + SPAN - 1
    data = data[_spread(begins, sizes)]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    edges = np.append(np.flatnonzero(np.append(True, np.diff(key) != 0)), len(key))
    i = 0
    while i < len(edges) - 1:  # collections of whole groups, about COLLECTION segments each
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + COLLECTION, "right")) - 1)
        a, b = edges[i], edges[j]
        if b - a > 1:
            found.append(_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], d[a:b], place[a:b]))
        i = j
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _runs(data: np.ndarray, offsets: np.ndarray, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, counts = _parts(place)
    at, seg = _spread(offsets[:-1], counts), np.repeat(np.arange(len(d)), counts)
    same = suffix_classes(data, offsets, SPAN)[at]
    least = np.full(int(same.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, d[seg])
    late = d[seg] > least[same]
    begins, stops = late.copy(), late.copy()
    begins[1:] &= ~(late[:-1] & (seg[1:] == seg[:-1]))
    stops[:-1] &= ~(late[1:] & (seg[1:] == seg[:-1]))
    i, j = np.flatnonzero(begins), np.flatnonzero(stops)
    s = seg[i]
    return d[s], (starts[s] + i - (np.cumsum(counts) - counts)[s]) << 32 | (j - i + 1) << 26 | (place[s] & _TAG)


def utf8_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(pa.compute.binary_length(column), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, key2, d): groups of segments, whole, and single windows, in passing."""
    held: pa.Table | None = None
    last: tuple[int, int, int] | None = None

    def out(d: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(place)], ["d", "place"])

    for b in batches:
        single = np.asarray(pa.compute.is_null(b.column("bytes")))
        if single.any():
            k1, k2, d, place = (np.asarray(b.column(c))[single] for c in ("key", "key2", "d", "place"))
            new = np.ones(len(d), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            low = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
            if last is not None and (k1[0], k2[0]) == last[:2]:
                low[: np.flatnonzero(np.append(new[1:], True))[0] + 1] = last[2]
            last = (k1[-1], k2[-1], low[-1])
            yield out(d[d > low], place[d > low])
        rest = pa.Table.from_batches([b.filter(pa.array(~single))])
        if held is not None:
            rest = pa.concat_tables([held, rest])
        if rest.num_rows:
            key = np.asarray(rest.column("key"))
            edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = rest.slice(edge)
            if edge:
                yield out(*_later(rest.slice(0, edge)))
    if held is not None and held.num_rows:
        yield out(*_later(held))


def covered(n: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + SPAN - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data, spots, found in zip(_texts(b), b.column("spots").to_pylist(), b.column("found").to_pylist(), strict=True):
            gone = covered(len(data), *_parts(np.array([x for x in spots or [] if x < 0] + (found or []), np.int64)))
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
            rows.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        cols = [b.column("h1"), b.column("h2"), b.column("d"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
        yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "first_id", "removed", "spans", "sha"])


def repeated_bytes(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text, ...).

    Null texts are empty; texts under ``SPAN`` bytes lose nothing.  Rows with one doc_id
    don't take from each other.  A row without doc_id neither loses bytes nor causes
    others to.  Other columns are ignored; an empty table gives an empty result.
    ``together`` only sets which of two equal ways an anchor's segments are compared.
    Of equal strings the one of the smallest doc_id stays, whatever the order of the rows.  Texts
    must be shorter than 2**25 segments, about half a gigabyte; a longer one is an error.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(SPAN), "text")})
    zipped = rows.select("doc_id", "h1", "h2", "text").mapInArrow(_zip, "doc_id long, h1 long not null, h2 long not null, zip binary not null")
    texts = zipped.groupBy("h1", "h2").agg(F.min("doc_id").alias("d"), F.first("zip").alias("zip"))
    tag = F.col("h1").bitwiseAND(F.lit(_TAG))
    keys = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("d")).withColumn("tag", tag)

    by_anchor = Window.partitionBy("anchor")
    high = F.shiftright("number", _HIGH)
    anchors = texts.select("d", "h1", "zip").mapInArrow(_anchor_rows, "anchor long, number long")
    several = anchors.withColumn("several", F.min(high).over(by_anchor) != F.max(high).over(by_anchor)).where(F.col("several") | (F.col("number").bitwiseAND(F.lit(_SHARED)) != 0))
    numbers = several.groupBy(high.alias("high")).agg(F.collect_list(F.col("number").bitwiseAND(F.lit(_SHARED - 1)).cast("int")).alias("numbers"))
    numbers = keys.withColumn("high", F.shiftright("h1", _HIGH)).join(numbers, "high").select("h1", "h2", "numbers")

    shared = texts.join(numbers, ["h1", "h2"]).select("d", tag.alias("tag"), "zip", "numbers").mapInArrow(_shared_rows, "anchor long, content long, d long, place long")
    same = Window.partitionBy("anchor", "content")
    met = shared.withColumn("first", F.min("d").over(same)).withColumns({"varied": F.min("content").over(by_anchor) != F.max("content").over(by_anchor), "size": F.count("d").over(by_anchor)})
    repeated = (F.col("d") > F.col("first")) | (F.col("place") < 0)
    mark = F.when(repeated, F.lit(_WHOLE)).when(F.col("size") > together, F.lit(_OPEN)).otherwise(F.lit(0))
    spots = met.where(repeated | F.col("varied")).select("d", F.col("place").bitwiseAND(F.lit(_TAG)).alias("tag"), F.col("place").bitwiseOR(mark).alias("place"))
    spots = keys.join(spots.groupBy("d", "tag").agg(F.collect_list("place").alias("spots")), ["d", "tag"]).select("h1", "h2", "spots")

    opened = texts.join(spots, ["h1", "h2"]).select("d", tag.alias("tag"), "zip", "spots").mapInArrow(_open_rows, "key long, key2 long, d long, place long, bytes binary")
    repeats = opened.repartition("key", "key2").sortWithinPartitions("key", "key2", "d").mapInArrow(_compare, "d long, place long")
    repeats = repeats.groupBy("d", F.col("place").bitwiseAND(F.lit(_TAG)).alias("tag")).agg(F.collect_list("place").alias("found"))
    repeats = keys.join(repeats, ["d", "tag"]).select("h1", "h2", "found")

    done = texts.join(spots, ["h1", "h2"], "left").join(repeats, ["h1", "h2"], "left").select("h1", "h2", "d", "zip", "spots", "found")
    done = done.mapInArrow(_result_rows, "h1 long, h2 long, first_id long, removed long, spans long, sha string")
    base = rows.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).alias("own"))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= SPAN)
    none = F.col("doc_id").isNull()
    pick = lambda free, all_of, else_: F.when(none, free).when(copy, all_of).otherwise(F.col(else_))
    return base.join(done, ["h1", "h2"]).select(
        "doc_id",
        "n_bytes",
        pick(F.lit(0), F.col("n_bytes"), "removed").cast("long").alias("n_removed"),
        pick(F.lit(0), F.lit(1), "spans").cast("long").alias("n_spans"),
        pick(F.col("own"), F.lit(hashlib.sha256(b"").hexdigest()), "sha").alias("kept_sha256"),
    )
