"""Document quality by compression.

Two zstandard dictionaries hold what is typical of good and of bad labelled texts.  A text
is compressed with each, in short blocks so that the dictionary and not the text itself
explains them; the difference of the two compressed sizes, over the size of the text, says
which dictionary knows it better, and a logistic curve turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.calibrate import Logistic, logistic
from lodestar.llm.common import chunks, labelled_sample, remainder, saved, utf8

#: Labelled rows used for fitting, at most; pieces of each class that its dictionary is trained on, at most, and their bytes; dictionary size.
FIT_ROWS, PIECES, PIECE, DICTIONARY = 12_000, 6_144, 2048, 256 << 10
BLOCK, LEVEL = 256, 3
MODULUS, HELD_OUT, CUT = 4, 2, 0.7


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes
        return b"".join(pieces)[-DICTIONARY:]


class Sizer:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.presses = []
        for d in (good, bad):
            kept = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
            kept.precompute_compress(level=LEVEL)
            self.presses.append(zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """Compressed bytes that the good dictionary saves over the bad one, for each byte."""
        good, bad = (sum(len(p.compress(b)) for b in blocks(text)) for p in self.presses)
        return (bad - good) / max(len(text), 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        parts = [blocks(t.encode(), PIECE) for t in b.column("text").to_pylist()]
        label = np.repeat(np.asarray(b.column("label")), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([x for p in parts for x in p], pa.binary())], ["label", "piece"])


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = utf8(batch.column("text"))
    raw, offs = data.tobytes(), offsets.tolist()
    return [raw[i:j] for i, j in zip(offs, offs[1:], strict=False)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: Logistic

    def differences(self):
        """A function from batches with texts and labels to labels and differences."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizer = Sizer(self.good, self.bad)
            for b in chunks(batches):
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([sizer.difference(t) for t in _raw(b)], pa.float64())], ["label", "difference"])

        return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Dictionaries and curve from at most ``rows`` labelled documents outside the held-out fold.

    Half of them make the dictionaries, the others the curve, so that no text is measured
    by a dictionary that holds it.  labels: (doc_id, label), label 1 for good.  The driver
    gets PIECES pieces of each class, those of smallest hash, and a number for each text.
    """
    sample = saved(labelled_sample(docs, labels, MODULUS, HELD_OUT, rows).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "quality_sample")
    pieces = sample.where("half = 0").select("text", "label").mapInArrow(_pieces, "label int, piece binary")
    some = [[bytes(r["piece"]) for r in pieces.where(F.col("label") == c).orderBy(F.xxhash64("piece"), "piece").limit(PIECES).select("piece").collect()] for c in (1, 0)]
    model = Model(*(dictionary(p) or b"\0" * 8 for p in some), None)
    got = sample.where("half = 1").select("text", "label").mapInArrow(model.differences(), "label int, difference double").toPandas().sort_values(["label", "difference"])
    y = got["label"].to_numpy()
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of good labels
        sums = sample.agg(F.sum("label"), F.count("*")).first()
        good, n = sums[0] or 0, sums[1]
        model.curve = Logistic(np.zeros(1), np.ones(1), np.array([0, float(np.log((good + 1) / (n - good + 1)))]))
    else:
        model.curve = logistic(got[["difference"]].to_numpy(), y)
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    score is 0 to 1, higher for good texts; predicted is 1 from ``CUT`` on.  Null and empty
    texts compress to nothing, a difference of 0, and get the curve's value there; texts of
    any length are compressed whole, block by block.  Only the text is looked at; repeated
    rows get equal scores, a null doc_id stays null and isn't held out, other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for b in chunks(batches):
            score = model.curve(np.array([sizer.difference(t) for t in _raw(b)], float).reshape(-1, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
