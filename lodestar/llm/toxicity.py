"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of a toxic passage against clean text, from labelled counts under a
Dirichlet prior; all other tokens share one small negative score.  One linear scan over a
document finds every maximal segment of positive score.  As the scores are log-likelihood
ratios, segment scores of clean texts follow an extreme-value law with rate 1, so that a
segment of score S in n tokens is expected K * n * exp(-S) times; the document's smallest
such value, on a logistic curve, is its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.calibrate import Logistic, logistic
from lodestar.llm.common import chunks, labelled_sample, remainder, saved, utf8
from lodestar.llm.words import words_of

#: Labelled rows used for fitting, at most; size of the lexicon, at most.
FIT_ROWS, LEXICON = 20_000, 20_000
#: Weight of the prior in documents; least significance of a lexicon word; share of lexicon words in a toxic passage.
PRIOR, LEAST_Z, DENSITY = 200.0, 4.0, 0.1
#: Expected number of clean segments as good, below which a passage counts as found.
SIGNIFICANT = 0.01
MODULUS, HELD_OUT, CUT = 5, 0, 0.5


def segments(at: np.ndarray, scores: np.ndarray, n: int, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) of n tokens, in one scan of linear time.

    at, scores: places and positive scores of the lexicon words; every other token scores
    ``background`` < 0.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum up to its end, nearest segment before it with a smaller sum before
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += background * (i - last)
        start, left = i, total
        total, last = total + s, i + 1
        j = len(found) - 1
        while j >= 0 and found[j][2] >= left:  # those that a link leaves out have larger sums still
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            start, _, left, _, before = found[j]
            del found[j:]
            j = before
        found.append((start, last, left, total, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass
class Model:
    hashes: np.ndarray
    scores: np.ndarray
    background: float
    k: float
    curve: Logistic

    def passages(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Token count and segments of each text."""
        w = words_of(data, offsets, lower=True, letters=True)
        out = []
        place = np.minimum(np.searchsorted(self.hashes, w.hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[place] == w.hashes if len(self.hashes) else np.zeros(len(w.hashes), bool)
        at = np.flatnonzero(hit)
        values = self.scores[place[at]]
        edges = np.searchsorted(at, w.first).tolist()
        first = w.first.tolist()
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            n = first[k + 1] - first[k]
            out.append((n, segments(at[i:j] - first[k], values[i:j], n, self.background) if j > i else []))
        return out

    def expected(self, n: int, score: float) -> float:
        return self.k * max(n, 1) * float(np.exp(-score))


def _features(n: np.ndarray, best: np.ndarray, k: float) -> np.ndarray:
    """Minus the log of the smallest expectation, bounded, 0 without segments; and whether there are any."""
    value = np.clip(best - np.log(k * np.maximum(n, 1)), 0, 30)
    return np.column_stack([np.where(best > 0, value, 0.0), best > 0])


def _strongest(found: list[tuple[int, list[tuple[int, int, float]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text and the score of its best segment, 0 without any."""
    return np.array([n for n, _ in found], np.int64), np.array([max((s for _, _, s in x), default=0.0) for _, x in found], float)


def _best(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            n, best = _strongest(model.passages(*utf8(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(n), pa.array(best)], ["label", "n", "best"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label each token is, and tokens by label."""
    for b in chunks(batches):
        w = words_of(*utf8(b.column("text")), lower=True, letters=True)
        label = np.asarray(b.column("label"), np.int64)
        owner = w.owner()
        for y in (0, 1):
            mine = label[owner] == y
            if mine.any():
                pairs = np.unique(np.stack([w.hashes[mine], owner[mine].astype(np.uint64)], axis=1), axis=0)
                tokens, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.full(len(tokens), y)), pa.array(n)], ["token", "label", "n"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Log-odds, extreme-value constant and curve from at most ``rows`` labelled documents outside the held-out fold.

    labels: (doc_id, label), label 1 for toxic.  Equal texts count once, as toxic if one of
    their rows is.  Without toxic labels, or without documents, all scores are 0.
    """
    sample = labelled_sample(docs, labels, MODULUS, HELD_OUT, rows).groupBy("text").agg(F.max("label").alias("label"))
    sample = saved(sample, "toxicity_sample")
    sizes = dict(sample.groupBy("label").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -0.1, 1.0, Logistic(np.zeros(2), np.ones(2), np.array([0.0, 0.0, -40.0])))
    counts = sample.mapInArrow(_counted, "token long, label long, n long").groupBy("token").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"))
    share = (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
    a1, a0 = F.col("y1") + PRIOR * n1 / (n1 + n0) * share, F.col("y0") + PRIOR * n0 / (n1 + n0) * share
    odds = F.log(a1 / (n1 + PRIOR * n1 / (n1 + n0))) - F.log(a0 / (n0 + PRIOR * n0 / (n1 + n0)))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    lexicon = counts.where("y1 >= 3").withColumns({"odds": odds, "z": z}).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "token").limit(LEXICON).toPandas()
    hashes = lexicon["token"].to_numpy(np.int64).view(np.uint64)
    extra = np.maximum(lexicon["y1"].to_numpy(float) / n1 - lexicon["y0"].to_numpy(float) / n0, 1e-9)
    tokens = max(1, int((sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6))
    clean = (lexicon["y0"].to_numpy(float) + 0.5 * extra / extra.sum() * len(extra) ** 0.5) / (tokens * n0 / (n1 + n0)) if len(extra) else np.zeros(0)
    order = np.argsort(hashes)
    scores = np.maximum(np.log(DENSITY * extra / extra.sum() / clean), 0.1) if len(extra) else np.zeros(0)
    model = Model(hashes[order], scores[order], float(np.log1p(-DENSITY)), 1.0, None)
    got = sample.mapInArrow(_best(model), "label int, n long, best double").toPandas().sort_values(["label", "n", "best"])  # a small row for each of at most `rows` texts
    y, n, best = got["label"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy()
    own = (y == 0) & (best > 0)
    model.k = min(max(float(max(own.sum(), 1) / max((n[own] * np.exp(-best[own])).sum(), 1e-12)), 1e-4), 1e4) if own.any() else 1.0
    model.curve = logistic(_features(n, best, model.k), y)
    return model


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, best_score) for every row of ``docs`` (doc_id, text, ...).

    score is 0 to 1, higher for toxic texts; predicted is 1 from ``CUT`` on; n_passages
    counts the segments expected less than ``SIGNIFICANT`` times in clean text, best_score
    is the best segment's, 0 without any.  Null and empty texts have no segments and the
    lowest score; very long ones are read whole, one at a time, in linear time.  Only the
    text is looked at; repeated rows get equal scores, of equally good segments the first
    counts, a null doc_id stays null and isn't held out, other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found = model.passages(*utf8(b.column("text")))
            tokens, best = _strongest(found)
            score = model.curve(_features(tokens, best, model.k))
            many = np.array([sum(model.expected(n, s) < SIGNIFICANT for _, _, s in x) for n, x in found], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(many), pa.array(best)], ["doc_id", "score", "n_passages", "best_score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double, n_passages long, best_score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_passages", "best_score")
