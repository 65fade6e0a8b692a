"""Rule statistics of documents and an isolation forest over them.

Random splits isolate unusual statistics after few steps; the mean path length over the
trees is the anomaly score.  The cut is set on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.joins import small
from lodestar.llm.common import chunks, saved, utf8
from lodestar.llm.words import Words, shingles, words_of

#: Scores are told apart in so many bins where the cut is set, and trees are so deep.
BINS, DEPTH = 1 << 16, 10
TREES, SAMPLE, SEED, MARGIN = 100, 256, 17, 4.0
#: Of the labelled good documents, at least this share stays.
KEEP_GOOD = 0.999
MIN_WORDS, MAX_REPEATED, REPEAT = 20, 30, 8
RATIOS = 7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows of REPEAT words that the text has twice or more."""
    if len(hashes) <= REPEAT:
        return 0
    _, where, n = np.unique(shingles(hashes, REPEAT), return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[where] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[at] += 1
    edge[at + REPEAT] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The COUNTS of each text, and the ratios that the forest splits on."""
    w: Words = words_of(data, offsets)
    n = len(offsets) - 1
    raw, offs, first = data.tobytes(), offsets.tolist(), w.first.tolist()
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per_word = chars[w.ends] - chars[w.starts]

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    by_text = np.concatenate(([0], np.cumsum(per_word)))
    words = np.diff(w.first)
    word_chars = by_text[w.first[1:]] - by_text[w.first[:-1]]
    symbols = inside(_SYMBOL[data])
    dups = np.array([_dup_lines(raw[a:b]) for a, b in zip(offs, offs[1:], strict=False)], np.int64)
    repeats = np.array([_repeated(w.hashes[a:b]) for a, b in zip(first, first[1:], strict=False)], np.int64)
    distinct = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(first, first[1:], strict=False)], np.int64)
    counts = np.stack([words, word_chars, symbols, dups, repeats], axis=1)
    at_least = np.maximum(words, 1)
    size = np.maximum(word_chars, 1)
    ratios = np.stack([word_chars / at_least, symbols / size, repeats / at_least, dups / at_least, inside(_UPPER[data]) / size, inside(_STOP[data]) / at_least, np.minimum(1, distinct / at_least ** 0.9)], axis=1)
    return counts.reshape(n, len(COUNTS)), ratios


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at leaves), threshold, children, and path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    usual: float
    limit: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): about 0.5 for ordinary rows, towards 1 for isolated ones."""
        total = np.zeros(len(x))
        for feature, cut, left, depth in zip(self.feature, self.cut, self.left, self.depth, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                i = np.flatnonzero(inner)
                k = node[i]
                node[i] = left[k] + (x[i, feature[k]] >= cut[k])
            total += depth[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _usual_path(n: float) -> float:
    return 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, margin: float = MARGIN, least: np.ndarray | None = None) -> Forest:
    """A forest over the rows of ``x``.

    Splits fall in the range of a node's rows (``least`` wide or wider), widened by
    ``margin`` times that on both sides, so that the space around the rows, which holds
    none of them, is split off after few steps.
    """
    rng = np.random.default_rng(seed)
    least = np.zeros(x.shape[1]) if least is None else least
    sample = min(sample, len(x))
    deepest = int(np.ceil(np.log2(max(sample, 2)))) + 2
    parts = []
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        open_nodes = [(0, rng.choice(len(x), sample, replace=False), 0)]
        while open_nodes:
            at, rows, depth = open_nodes.pop()
            if depth >= deepest or len(rows) < 2:
                nodes[at] = [-1, 0.0, 0, depth + _usual_path(len(rows))]
                continue
            f = int(rng.integers(x.shape[1]))
            low, high = x[rows, f].min(), x[rows, f].max()
            span = margin * max(high - low, least[f])
            cut = rng.uniform(low - span, high + span)
            up = x[rows, f] >= cut
            nodes[at] = [f, cut, len(nodes), 0.0]
            open_nodes += [(len(nodes), rows[~up], depth + 1), (len(nodes) + 1, rows[up], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        parts.append(np.array(nodes))
    size = max(map(len, parts))
    grid = np.full((trees, size, 4), -1.0)
    for k, p in enumerate(parts):
        grid[k, : len(p)] = p
    return Forest(grid[..., 0].astype(np.int64), grid[..., 1], grid[..., 2].astype(np.int64), grid[..., 3], max(_usual_path(sample), 1.0))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


def _kept(counts: np.ndarray, ratios: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts stay, which fail the base rules, and the anomaly scores."""
    failed, score = base_failed(counts), forest.scores(ratios)
    return ~failed & (score < forest.limit), failed, score


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        counts, ratios = statistics(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(c) for c in counts.T), *(pa.array(r) for r in ratios.T)], ["label", *COUNTS, *(f"r{k}" for k in range(ratios.shape[1]))])


def _features(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f"r{k}").to_numpy() for k in range(RATIOS)], axis=1) if len(b) else np.zeros((0, RATIOS))


def _ranges(feature: np.ndarray, cut: np.ndarray, left: np.ndarray):
    """(node, feature, n, low, high) of a partition: the rows that reach each open node (feature -2), for every ratio; nodes are numbered through all trees."""
    trees, size = feature.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(trees * size, np.int64), np.full((trees * size, RATIOS), np.inf), np.full((trees * size, RATIOS), -np.inf)
        for b in batches:
            x = _features(b)
            for tree in range(trees):
                node = np.zeros(len(x), np.int64)
                while (inner := feature[tree, node] >= 0).any():
                    i = np.flatnonzero(inner)
                    k = node[i]
                    node[i] = left[tree, k] + (x[i, feature[tree, k]] >= cut[tree, k])
                at = np.flatnonzero(feature[tree, node] == -2)
                own = tree * size + node[at]
                n += np.bincount(own, minlength=len(n))
                order = np.argsort(own, kind="stable")
                names, first = np.unique(own[order], return_index=True)
                if len(names):
                    low[names] = np.minimum(low[names], np.minimum.reduceat(x[at[order]], first))
                    high[names] = np.maximum(high[names], np.maximum.reduceat(x[at[order]], first))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(side[at, k]) for side in (low, high) for k in range(RATIOS))], ["node", "n", *(f"low{k}" for k in range(RATIOS)), *(f"high{k}" for k in range(RATIOS))])

    return run


def grown(rows: DataFrame, least: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, margin: float = MARGIN) -> Forest:
    """As :func:`grow`, from all ``rows`` (r0, r1, ...) in every tree: one pass over them for each level of all trees, from which the driver gets the ranges of the open nodes."""
    rng = np.random.default_rng(seed)
    size = (2 << depth) - 1
    feature, cut, left, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    feature[:, 0], used, usual = -2, np.ones(trees, np.int64), 1.0
    lows, highs = [f"low{k}" for k in range(RATIOS)], [f"high{k}" for k in range(RATIOS)]
    schema = "node long, n long, " + ", ".join(f"{c} double" for c in lows + highs)
    for level in range(depth + 1):
        found = rows.mapInArrow(_ranges(feature, cut, left), schema).groupBy("node").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs)).toArrow()
        got = {at: k for k, at in enumerate(found.column("node").to_pylist())}
        n = found.column("n").to_numpy()
        low, high = (np.stack([found.column(c).to_numpy() for c in names], axis=1) for names in (lows, highs))
        if level == 0:
            usual = _usual_path(float(n.max(initial=0)))
        for tree, node in zip(*np.nonzero(feature == -2), strict=True):
            k = got.get(tree * size + node)
            here = 0 if k is None else int(n[k])
            if level == depth or here < 2:
                feature[tree, node], length[tree, node] = -1, level + _usual_path(here)
                continue
            f = int(rng.integers(RATIOS))
            span = margin * max(high[k, f] - low[k, f], least[f])
            feature[tree, node], cut[tree, node], left[tree, node] = f, rng.uniform(low[k, f] - span, high[k, f] + span), used[tree]
            feature[tree, used[tree] : used[tree] + 2] = -2
            used[tree] += 2
    width = int(used.max())
    return Forest(feature[:, :width], cut[:, :width], left[:, :width], length[:, :width], max(usual, 1.0))


def _score_bins(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.minimum(forest.scores(_features(b)) * BINS, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("label")], ["bin", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest of good labelled documents, and the cut between good and bad ones.

    docs: (doc_id, text), labels: (doc_id, label), label 1 for good.  All labelled documents
    count, in each tree and in the cut; the driver gets ranges of nodes and counts of score
    bins.  The cut has the best balanced accuracy among the edges of bins that keep KEEP_GOOD
    of the good ones.  Without good labels nothing is an anomaly.
    """
    known = docs.select("doc_id", "text").join(small(labels, 1 << 20), "doc_id").select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    schema = "label int, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"r{k} double" for k in range(RATIOS))
    rows = saved(known.mapInArrow(_measured, schema), "labelled_statistics")
    rows = rows.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEATED * F.col("n_words")))
    good = rows.where("label = 1")
    if good.isEmpty():
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), int), np.ones((1, 1)), 1.0)
    forest = grown(good, np.array(rows.agg(*(F.round(F.stddev_pop(f"r{k}"), 9) for k in range(RATIOS))).first()))  # rounded: sums hang on the order of rows
    counts = np.zeros((2, BINS), np.int64)
    for r in rows.mapInArrow(_score_bins(forest), "bin long, label int").groupBy("bin", (F.col("label") == 1).cast("int").alias("good")).agg(F.count("*").alias("n")).collect():
        counts[r["good"], r["bin"]] += r["n"]
    bad, kept = (np.append(0, np.cumsum(c)) for c in counts)  # below each edge
    value = kept / kept[-1] + 1 - bad / max(bad[-1], 1)
    value[kept < KEEP_GOOD * kept[-1]] = -1
    best = np.flatnonzero(value == value.max())
    forest.limit = float((best[0] + best[np.flatnonzero(np.append(np.diff(best) > 1, True))[0]]) / 2 / BINS)  # between the good and the bad, where edges are as good
    return forest


def passing(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, all columns as they were, read once and without a shuffle.

    Each row is judged by its own text, also where rows share a doc_id or have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            counts, ratios = statistics(*utf8(b.column("text")))
            yield b.filter(pa.array(_kept(counts, ratios, forest)[0]))

    return docs.mapInArrow(run, docs.schema)


def quality_verdicts(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, kept, anomaly) for every row of ``docs`` (doc_id, text, ...).

    Words are runs of characters other than 0x20 and 0x09-0x0D.  n_words under
    ``MIN_WORDS`` or over ``MAX_REPEATED`` % repeated words fail the base rules and are
    not kept; others are kept unless their anomaly score passes the forest's cut.  Null
    texts have no words and fail; texts of any length are read whole, long ones one at a
    time; an anomaly just at the cut isn't kept.  Repeated rows are judged each for itself, a
    null doc_id stays null, other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            counts, ratios = statistics(*utf8(b.column("text")))
            kept, failed, score = _kept(counts, ratios, forest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")
