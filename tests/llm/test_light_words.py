"""Words that the trie of the language model has no numbers for are words of the model all the same."""

import zlib

import pytest

from lodestar.llm import lm_scoring
from lodestar.llm.lm_scoring import fit, language_scores, scores
from tests.llm.test_lm_scoring import Plain, compare, corpus


@pytest.mark.parametrize(("numbered", "trie"), [(100, 300), (30, 1), (300, 1 << 22)])
def test_few_numbered_words(frame, monkeypatch, numbered, trie):
    monkeypatch.setattr(lm_scoring, "NUMBERED", numbered)
    monkeypatch.setattr(lm_scoring, "TRIE", trie)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 1000)
    rare = [f"{a} {b} {c}" for a, b, c in (("odd1", "odd2", "odd3"), ("w3", "odd1", "odd2"), ("odd4", "w5", "odd1"), ("odd4", "w5", "odd9"))] * 2
    unseen = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = [*enumerate([*corpus(150, 3), *rare, "", "w1"]), (unseen, "unseen unseen w3 unseen odd1 unseen")]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    model = Plain([t for i, t in docs if not held[i]], 1 << 60, 1 << 22)
    light = {w for w, n in model.c.items() if n < model.total / numbered}
    assert {sum(w in light for w in x) for x in model.pairs} == {0, 1, 2} and any(light & set(x) for x in model.triples)
    table = frame([t for _, t in docs], [i for i, _ in docs]).repartition(3)
    got = {r["doc_id"]: r for r in language_scores(table).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held
    compare(got, docs, model)
    if trie == 300:  # documents that the model is not of, some of them held out
        some = table.where("doc_id < 40 or doc_id > 140").selectExpr("doc_id", "true AS held_out", "text")
        other = {r["doc_id"]: r for r in scores(some, fit(table.where(f"doc_id in ({','.join(str(i) for i in held if not held[i])})"))).collect()}
        compare(other, [(i, t) for i, t in docs if i in other], model)
        assert len(other) > 50


def test_whole_model_in_place(frame):
    """Small inputs have numbers for all words."""
    docs = list(enumerate(corpus(60, 5)))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    got = {r["doc_id"]: r for r in language_scores(frame([t for _, t in docs])).collect()}
    compare(got, docs, Plain([t for i, t in docs if not held[i]], 1 << 60, 1 << 22))
