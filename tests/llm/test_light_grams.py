"""N-grams that the trie of the language model doesn't hold are in the model all the same."""

import zlib

import numpy as np
import pytest

from lodestar.llm import lm_scoring
from lodestar.llm.lm_scoring import Model, fit, language_scores, scores
from tests.llm.test_lm_scoring import Plain, compare, corpus


def test_least_does_not_depend_on_size():
    none = np.zeros(0, np.int64)
    assert [Model(total, 3, 1, none, none, np.zeros(3, np.int64)).least() for total in (10, 1 << 24, 1 << 40)] == [2, 2, 2]


@pytest.mark.parametrize(("inverse_words", "trie"), [(1 << 20, 300), (100, 300), (100, 40), (1 << 20, 1)])
def test_small_trie(frame, monkeypatch, inverse_words, trie):
    monkeypatch.setattr(lm_scoring, "WORDS", inverse_words)
    monkeypatch.setattr(lm_scoring, "TRIE", trie)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 1000)
    docs = list(enumerate([*corpus(150, 3), "", "w1"]))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    model = Plain([t for i, t in docs if not held[i]], inverse_words, 1 << 22)
    table = frame([t for _, t in docs]).repartition(3)
    got = {r["doc_id"]: r for r in language_scores(table).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held
    compare(got, docs, model)
    if trie == 300:  # documents that the model is not of, some of them held out
        some = table.where("doc_id < 40").selectExpr("doc_id", "true AS held_out", "text")
        other = {r["doc_id"]: r for r in scores(some, fit(table.where(f"doc_id in ({','.join(str(i) for i in held if not held[i])})"))).collect()}
        assert len(other) == 40
        compare(other, docs[:40], model)
