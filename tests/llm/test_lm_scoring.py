"""The language model against a plain one of dictionaries, and its sequences against sorted arrays."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import lm_scoring
from lodestar.llm.elias_fano import Sequence
from lodestar.llm.lm_scoring import BEGIN, DISCOUNT, END, RARE, fit, language_scores, log_chances, packed, read, unpacked

END_MARK, START, CLASS = "</s>", "<s>", "<rare>"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    """The model's definition over dictionaries, probabilities not rounded."""

    def __init__(self, texts, inverse_words, inverse_grams):
        self.c = Counter()
        for t in texts:
            self.c.update([*words(t), END_MARK])
        self.total, self.kinds = sum(self.c.values()), len(self.c)
        self.known = {w for w, n in self.c.items() if n >= self.total / inverse_words} | {END_MARK}
        least = max(2, -(-self.total // inverse_grams))
        lines = [[START, *map(self.named, [*words(t), END_MARK])] for t in texts]
        pairs = Counter((a, b) for x in lines for a, b in zip(x, x[1:]))
        self.pairs = {k: n for k, n in pairs.items() if n >= least}
        triples = Counter((a, b, c) for x in lines for a, b, c in zip(x, x[1:], x[2:]) if (a, b) in self.pairs and (b, c) in self.pairs)
        self.triples = {k: n for k, n in triples.items() if n >= least}
        self.before = Counter(a for x in lines for a in x[:-1])
        self.class_share = 1 - sum(self.base(w) for w in self.known if self.c[w] or w == END_MARK)

    def named(self, w):
        return w if w in self.known else CLASS

    def base(self, w):
        return (self.c[w] + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def chance(self, ctx, w):
        """Of the word number class ``w`` after the last two of ``ctx``."""
        one = self.class_share if w == CLASS else self.base(w)
        b = ctx[-1]
        left = 1 - sum((n - DISCOUNT) / self.before[b] for (x, _), n in self.pairs.items() if x == b)
        two = ((self.pairs[b, w] - DISCOUNT) / self.before[b] if (b, w) in self.pairs else 0) + left * one
        if len(ctx) < 2 or (ctx[-2], b) not in self.pairs:
            return two
        n = self.pairs[ctx[-2], b]
        left = 1 - sum((m - DISCOUNT) / n for (x, y, _), m in self.triples.items() if (x, y) == (ctx[-2], b))
        return ((self.triples[ctx[-2], b, w] - DISCOUNT) / n if (ctx[-2], b, w) in self.triples else 0) + left * two

    def score(self, text):
        ctx, out = [START], 0.0
        for w in [*words(text), END_MARK]:
            name = self.named(w)
            out += math.log10(self.chance(ctx, name))
            if name == CLASS:
                out += math.log10(self.base(w) / self.class_share)
            ctx.append(name)
        return out


def corpus(n, seed, kinds=40):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(kinds)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(r.randrange(0, 40)):
            text.append(pool[(pool.index(text[-1]) * 3 + 1) % kinds] if text and r.random() < 0.5 and text[-1] in pool else r.choice(pool) if r.random() < 0.9 else f"odd{r.randrange(90)}")
        out.append(" ".join(text).replace("w1", "W1"))
    return out


def compare(got, docs, model, tolerance=2e-3):
    """Scores follow the plain model, up to rounded probabilities (a token is at most four steps off)."""
    for i, text in docs:
        r = got[i]
        tokens = [*words(text), END_MARK]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(model.c[w] > 0 for w in tokens), model.total)
        assert math.isclose(r["base_score"], sum(math.log10(model.base(w)) for w in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert abs(r["score"] - model.score(text)) <= tolerance * len(tokens)


@pytest.mark.parametrize(("inverse_words", "inverse_grams"), [(1 << 20, 1 << 22), (100, 1 << 22), (100, 300), (2, 2)])
def test_against_plain_model(frame, monkeypatch, inverse_words, inverse_grams):
    monkeypatch.setattr(lm_scoring, "WORDS", inverse_words)
    monkeypatch.setattr(lm_scoring, "GRAMS", inverse_grams)
    docs = list(enumerate(corpus(150, 3)))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    model = Plain([t for i, t in docs if not held[i]], inverse_words, inverse_grams)
    got = {r["doc_id"]: r for r in language_scores(frame([t for _, t in docs]).repartition(3)).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held
    compare(got, docs, model)
    if inverse_words == 100:
        assert len(model.known) < model.kinds
    if inverse_grams == 1 << 22:
        assert sum(got[i]["score"] - got[i]["base_score"] for i, _ in docs if held[i]) > 0


def test_odd_tables(odd, frame, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS", 50)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    model = Plain([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1], 50, 1 << 22)
    got = language_scores(odd).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in rows)
    left = list(got)
    for i, text in rows:  # repeated ids have texts of their own
        mine = min((r for r in left if r["doc_id"] == i), key=lambda r: abs(r["score"] - model.score(text)) + abs(r["n_tokens"] - len(words(text)) - 1))
        left.remove(mine)
        compare({i: mine}, [(i, text)], model)
    assert language_scores(frame([])).collect() == []


def test_nothing_to_learn_from(frame):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = language_scores(frame(["a b", "", None], ids)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert all(r["held_out"] and abs(r["score"]) < 1e-6 for r in got)


@pytest.mark.parametrize("inverse_words", [1 << 20, 100])
def test_continuations_add_up_to_one(spark, frame, monkeypatch, inverse_words):
    monkeypatch.setattr(lm_scoring, "WORDS", inverse_words)
    trained = fit(frame(corpus(120, 9)))
    model = unpacked(packed(trained.model))
    known = [k for k in range(model.size) if k not in (BEGIN,)]
    assert model.second.keys.n > 50 and model.third.keys.n > 20
    name = {int(n): int(h) for h, n in zip(model.words, model.number, strict=True)}
    for a, b in [(BEGIN, None), (3, 4), (5, RARE), (7, 22), (4, 13), *((3, k) for k in range(5, 30, 4))]:
        lead = [x for x in (a, b) if x not in (None, BEGIN)]
        total = 0.0
        for w in known:
            number = np.array([*lead, w], np.int64)
            before = np.array([BEGIN, *number[:-1]], np.int64)
            begins = np.arange(len(number)) == 0
            pair = model.second.find(model.size, before, number)
            total += 10 ** log_chances(model, lm_scoring.Read(None, number, before, begins, pair))[-1]
        assert abs(total - 1) < 2e-3
    assert END in known and len(name) == model.size - 3


def test_model_file(frame):
    texts = corpus(80, 4)
    model = fit(frame(texts)).model
    again, column = unpacked(packed(model)), pa.array([*texts, None, "", "never seen"])
    assert np.array_equal(log_chances(model, read(model, column)), log_chances(again, read(again, column)))
    assert not again.second.keys.low.flags.owndata  # views of the file


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (1, 1000), (64, 64), (128, 129), (100, 100), (1000, 50_000), (70_000, 10**6), (3000, 1 << 40)])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n)) if n < top else np.arange(n)
    v = v.astype(np.int64)
    s = Sequence.of(v)
    assert np.array_equal(s[np.arange(len(v))], v) if len(v) else True
    x = np.concatenate([rng.integers(0, top + top // 3 + 200, 2000), v, v + 1])
    at, there = s.successor(x)
    assert np.array_equal(there, np.isin(x, v)) and np.array_equal(at[there], np.searchsorted(v, x[there]))


def test_sequence_of_crowded_parts():
    v = np.concatenate([np.arange(500), np.arange(10**6, 10**6 + 700), [10**7]]).astype(np.int64)
    s = Sequence.of(v)
    x = np.append(np.random.default_rng(2).integers(0, 10**7 + 10, 20_000), v)
    at, there = s.successor(x)
    assert np.array_equal(there, np.isin(x, v)) and np.array_equal(at[there], np.searchsorted(v, x[there]))
    assert len(s.low) + 8 * len(s.high) < 3 * len(v) + 1000
