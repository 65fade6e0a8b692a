"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import lexical_search
from lodestar.llm.lexical_search import indexed, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, queries, top=10):
    """{(item_id, rank, doc_id, score)} of (doc_id, text) and (item_id, text)."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for b in bags if b[2]), sum(b[2] for b in bags)
    df = Counter(t for b in bags for t in b[1])
    asked = {}
    for i, t in queries:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, bag, length in bags:
            m = 10 + (90 * length * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in words if bag[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    common, rare = ["the", "of", "And", "é", "x9"], [f"w{k}" for k in range(300)]
    return [(k, " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(1, 50)))) for k in range(n)]


@pytest.mark.parametrize(("block_docs", "steps"), [(64, (4, 64)), (3, (1,)), (1, (2, 3)), (5, ())])
def test_against_all_scores(spark, frame, block_docs, steps):
    docs = corpus(150, 7)
    docs += [(1000 + k, docs[3][1]) for k in range(25)]  # ties that leave no room
    random.Random(1).shuffle(docs)
    queries = [(k, t) for k, t in corpus(12, 8)] + [(50, docs[3][1]), (51, "nowhere to be found?"), (52, ""), (53, None), (None, "the w1"), (54, "W2 w3"), (54, "w4")]
    df = frame([t for _, t in docs], [i for i, _ in docs]).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert rows_of(ranked(indexed(df, block_docs), asked, steps=steps)) == plain(docs, queries)


def test_parts_and_shuffled_choices(spark, frame, monkeypatch):
    docs, queries = corpus(60, 3), corpus(9, 4)
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", 40)
    monkeypatch.setattr(lexical_search, "BROADCAST_CHOICE", 0)
    got = ranked(indexed(frame([t for _, t in docs]), 4), spark.createDataFrame(queries, "item_id long, text string"), top=3)
    assert rows_of(got) == plain(docs, queries, 3)


def test_odd_tables(spark, odd, frame):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    queries = [(1, "alpha1 beta2 no id here x é"), (2, "ab İ"), (2, "word")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert rows_of(ranked(indexed(odd), asked)) == plain(rows, queries)
    assert rows_of(ranked(indexed(frame([])), asked)) == []
    assert rows_of(ranked(indexed(odd), asked.limit(0))) == []
    assert rows_of(ranked(indexed(frame(["same", "same"])), spark.createDataFrame([(1, "same")], "item_id long, text string"))) == plain([(0, "same"), (1, "same")], [(1, "same")])


def test_blocks_are_left_out(spark, frame, monkeypatch):
    """Where a few blocks hold all good documents, the rest is never scored."""
    docs = [(k, "the of " * 20 + (f"needle{k} " * 3 if k < 12 else "")) for k in range(400)]
    seen = []
    first = lexical_search.saved
    monkeypatch.setattr(lexical_search, "saved", lambda df, name, **o: seen.append((name, out := first(df, name, **o))) or out)
    queries = [(1, "the " + " ".join(f"needle{k}" for k in range(12)))]
    got = rows_of(ranked(indexed(frame([t for _, t in docs]).coalesce(1), 4), spark.createDataFrame(queries, "item_id long, text string")))
    assert got == plain(docs, queries)
    assert sum(df.count() for name, df in seen if name == "chosen_blocks") <= 4 < next(df.count() for name, df in seen if name == "bounds") == 100
