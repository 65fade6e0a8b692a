"""Divergence of sources against a plain dense computation."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import divergence
from lodestar.llm.divergence import divergences

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top=50):
    """rows: (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang, _ in groups}
    out = set()
    whole = {lang: Counter() for lang in kept}
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def chances(count, lang):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return [1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept[lang]]

    p = {(lang, source): chances(counts[lang, source], lang) for lang, source in groups}
    for lang, source in groups:
        q = chances(whole[lang], lang)
        pairs = [(sum(abs(a - b) for a, b in zip(p[lang, source], p[g], strict=True)), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(a - b, t) for a, b, t in zip(p[lang, source], q, kept[lang], strict=True) if a > b and counts[lang, source][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(order)}
    return out


def rows_of(df):
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "delta", "É", "zeta9eta", "x-y", "İz", "\U0001f642", "theta", *(f"w{chr(97 + k)}" for k in range(20))]
    for k in range(n):
        source = "hot" if k % 3 else r.choice(["a", "b", "c", "é", None])
        yield r.choice(["en", "fr", None]), source, r.choice([None, "", " ", "1 2"]) if k % 11 == 0 else " ".join(r.choice(words[: 8 + len(source or "") * 5]) for _ in range(r.randrange(1, 60)))


@pytest.mark.parametrize(("least", "few"), [(1, 100_000), (4, 100_000), (4, 1), (1000, 100_000)])
def test_against_dense_form(spark, monkeypatch, least, few):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", few)  # few groups are sent to all, many shuffled
    rows = [*corpus(120, 5), ("xx", "alone", "lone"), ("yy", "empty", None), ("yy", "other", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = rows_of(divergences(df, least=least))
    assert got == plain(rows, least)
    if least == 1000:
        assert {r[2] for r in got} == {"pair"} and {r[4] for r in got} == {0}


def test_odd_tables(odd, frame):
    tagged = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s")).withColumn("p", F.lit(1)).withColumn("item", F.lit("z")).withColumn("total", F.lit("t"))
    rows = [(r["lang"], r["source"], r["text"]) for r in tagged.collect()]
    assert rows_of(divergences(tagged, least=2)) == plain(rows, 2)
    empty = divergences(frame([]))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(divergences(frame(["one"]), least=1)) == set()


def test_counts_beyond_64_bits(spark):
    """Probabilities are exact where count * SCALE leaves 64 bits."""
    df = spark.createDataFrame([(10**11, 3 * 10**11, 7), (0, 0, 0)], "n long, total long, terms long")
    got = [r[0] for r in df.select(divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (10**11 + 5) // (3 * 10**11 + 35), None]


def test_no_dense_frame(spark, frame):
    """Joins are by language or term, never a product."""
    text = divergences(frame(["a b", "b c"], None))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
