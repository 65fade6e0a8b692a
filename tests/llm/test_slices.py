"""What op13 writes and shuffles in tables whose n-grams the trie doesn't all hold."""

import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import lm_scoring
from lodestar.llm.elias_fano import Sequence
from lodestar.llm.lm_scoring import RARE, fit
from tests.llm.test_lm_scoring import corpus, words


@pytest.fixture
def small(monkeypatch):
    for name, value in (("WORDS", 100), ("TRIE", 300), ("BUCKET_TOKENS", 500), ("SLICE_BYTES", 1000)):
        monkeypatch.setattr(lm_scoring, name, value)


def test_shuffle_files_go_when_counts_are_there(spark, frame, small):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting, None)
    before = files()
    model = fit(frame(corpus(150, 3)).repartition(3)).model
    assert model.second.keys.n > 20
    for _ in range(40):
        if not (left := files() - before):
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get(setting, None) == own


def test_slices_hold_numbers_and_rare_words_by_document(frame, small):
    texts = [*corpus(150, 3), "", None, "odd odd odd"]
    trained = fit(frame(texts).repartition(3))
    known, numbers, rare = set(trained.model.words.tolist()), 0, Counter()
    for s in trained.slices.collect():
        doc = dict(zip(s["row"], s["doc_id"], strict=True))
        number = np.frombuffer(s["number"], np.uint8).reshape(4, -1).T.copy().view("<i4")
        assert len(number) == s["first"][-1]
        assert (number == RARE).sum() == sum(s["rare_times"])
        assert len(s["rare_word"]) == len(set(zip(s["rare_row"], s["rare_word"], strict=True))) and not known & set(s["rare_word"])
        numbers += len(number)
        for row, times in zip(s["rare_row"], s["rare_times"], strict=True):
            rare[doc[row]] += times
    counts = Counter(w for t in texts for w in words(t))
    total = sum(counts.values()) + len(texts)
    assert numbers == total
    assert {i: n for i, t in enumerate(texts) if (n := sum(counts[w] < total / 100 for w in words(t)))} == dict(rare)


def test_sequence_reads_each_number_once(monkeypatch):
    v = np.arange(0, 3000, 3)
    s, sizes = Sequence.of(v), []
    low = Sequence._low
    monkeypatch.setattr(Sequence, "_low", lambda self, i: sizes.append(len(i)) or low(self, i))
    x = np.random.default_rng(1).permutation(np.repeat(np.arange(300), 50))
    at, there = s.successor(x)
    assert np.array_equal(there, x % 3 == 0) and np.array_equal(v[at[there]], x[there])
    assert max(sizes) <= 300
