"""Packing as an exact round trip."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD_TEXTS, prose

from lodestar.llm import packing


def whole(text):
    return packing.encoder(packing.vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def own(texts):
    data = [(t or "").encode() for t in texts]
    ids, counts = packing.encoder(packing.vocabulary()).encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_encoder_on_any_text(texts):
    assert own(texts) == [whole(t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="\u0130Iıi\u0307aŞßẞǅﬁ.-_#!,' \n3", max_size=12), min_size=1, max_size=4))
def test_encoder_on_letters_with_odd_lower_case(texts):
    assert own(texts) == [whole(t)[:-1] for t in texts]


@pytest.mark.parametrize("text", ["\u0130... x", "\u0130--", "\u0130_", "\u0130#", "a\u0130\u0130!", "a\x1cb", "a b<|endoftext|>c", "é x", "İ İx", "ΑΣ ΣΑΣ", "x\x85y z", "don't  we'll", "12 3a", " ́a b", "A.B,c!! D... (e)", "Ab́c. Q̇", "x<|ENDOFTEXT|>y", "<|StartOfText|> z <|startoftext|>"])
def test_encoder_on_odd_text(text):
    assert own([text]) == [whole(text)[:-1]]


def check(rows, texts, ids, window=2048):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    seen = 0
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array(whole(t), "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(tokens))
            assert r["ids_crc32"] == zlib.crc32(tokens[at : at + r["length"]].tobytes())
            at += r["length"]
            seen += 1
        assert at == len(tokens)
    assert seen == len(rows)
    for k in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == k), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0  # full, or a power of two


def test_round_trip(frame):
    texts = [*ODD_TEXTS, *(prose(k, 30 * k) for k in range(1, 40)), prose(5, 9000)]
    check(packing.packed(frame(texts)).collect(), texts, range(len(texts)))
    check(packing.packed(frame(texts), shard_tokens=3000).collect(), texts, range(len(texts)))


def test_odd(odd, frame):
    rows = packing.packed(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(whole(r["text"])) for r in odd.collect())
    assert packing.packed(frame([])).count() == 0


def test_neighbours_share_windows():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * topic, 1000 * topic + 50, 500).astype("<u4") for _ in range(8) for topic in range(1, 9)]
    topics = [i % 8 for i in range(len(docs))]
    full = [s for s in packing.fill(docs, 2048) if sum(p[2] for p in s) == 2048]
    mixed = [len({topics[i] for i, _, _ in s}) for s in full]
    assert np.mean(mixed) < 2


def test_neighbours_meet_in_shards(frame):
    """Documents of one topic share windows also when there are many shards."""
    r = random.Random(3)
    words = [[f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("x", "z", "rg", "lt")][30 * k : 30 * k + 30] for k in range(8)]
    topics = [r.randrange(8) for _ in range(320)]
    rows = packing.packed(frame([" ".join(r.choices(words[k], k=150)) for k in topics]), shard_tokens=4000, window=1024).collect()
    assert len({row["sequence_id"] >> 32 for row in rows}) > 8
    held = {}
    for row in rows:
        held.setdefault(row["sequence_id"], []).append(row)
    mixed = [len({topics[row["doc_id"]] for row in s}) for s in held.values() if sum(row["length"] for row in s) == 1024]
    assert np.mean(mixed) < 1.6


def test_scores_are_bm25():
    """The index against the formula, document by document, and the fill of the first window against their order."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40, int(rng.integers(5, 60))).astype("<u4") for _ in range(30)]
    index, mean = packing.Index(docs), np.mean([len(d) for d in docs])
    sets = [set(d.tolist()) for d in docs]
    for i, own in enumerate(sets):
        want = []
        for d in docs:
            score = 0.0
            for t in own:
                tf, df = int((d == t).sum()), sum(t in s for s in sets)
                score += np.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            want.append(score)
        assert np.allclose(index.scores(i), want, rtol=1e-4)
    seed = int(np.argsort([-len(d) for d in docs], kind="stable")[0])
    order = [seed] + [int(i) for i in np.argsort(-index.scores(seed), kind="stable") if i != seed]
    first = packing.fill(docs, 128)[0]
    assert [i for i, _, _ in first] == order[: len(first)] and sum(n for _, _, n in first) == 128


def test_other_tokenizers_get_whole_texts():
    code = packing.Encoder(packing.vocabulary("byte_bpe_50k.json"))
    texts = ["The quick Brown fox", " lead", "a  b\n\nc", "", "don't"]
    data = [t.encode() for t in texts]
    ids, counts = code.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64))
    assert not code.by_stretches and packing.encoder(packing.vocabulary()).by_stretches
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_term_counts():
    rng = np.random.default_rng(5)
    for kind in ("<u2", "<u4"):
        docs = [rng.integers(0, 9, n).astype(kind) for n in (3, 0, 20, 1)]
        doc, term, tf = packing.term_counts(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
        assert list(zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(i, t, int((d == t).sum())) for i, d in enumerate(docs) for t in np.unique(d).tolist()]


def test_corpus_statistics(frame, spark):
    """Weights are those of the whole corpus, however many partitions hold it, and not of a shard."""
    texts = [prose(k, 60) for k in range(40)]
    ids = spark.createDataFrame([(k, np.array(whole(t), "<u2").tobytes()) for k, t in enumerate(texts)], "doc_id long, ids binary").repartition(5)
    got = packing.corpus_of(ids, "<u2", packing.encoder(packing.vocabulary()).size)
    docs = [np.array(whole(t), "<u4") for t in texts]
    df = np.zeros(len(got.idf))
    for d in docs:
        df[np.unique(d)] += 1
    assert got.mean == np.mean([len(d) for d in docs])
    assert np.allclose(got.idf, np.log(1 + (40 - df + 0.5) / (df + 0.5)), rtol=1e-5)
    part = packing.Index(docs[:8], got)
    alone = packing.Index(docs[:8])
    assert not np.allclose(part.weights, alone.weights)
