"""Texts of megabytes: every operator reads them whole."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import prose

from lodestar.llm import html_text, packing, pii, quality_classifier, quality_rules, secrets, toxicity
from lodestar.llm.calibrate import Logistic
from lodestar.llm.decontaminate import contaminated
from lodestar.llm.divergence import divergences
from lodestar.llm.lexical_search import indexed, ranked
from lodestar.llm.lm_scoring import language_scores
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.suffix_dedup import repeated_bytes
from lodestar.llm.words import words_of

ITEM = prose(777, 20)
LONG = "\n".join(prose(k, 5000) for k in range(60)) + f"\nwrite to a.b@example.org, token = abcdef12 wretch wretch\n{ITEM}\n"


@pytest.fixture(scope="module")
def long(spark):
    from tests.llm.conftest import SCHEMA

    assert len(LONG) > 2_000_000
    return spark.createDataFrame([(1, LONG, None, None, None), (2, LONG + "the end", None, None, None), (3, "short", None, None, None)], SCHEMA)


def test_near_duplicates_and_repeats(long):
    got = {r["doc_id"]: r for r in near_duplicates(long, 5).collect()}
    assert (got[1]["component_id"], got[2]["component_id"], got[3]["component_id"]) == (1, 1, 3)
    gone = {r["doc_id"]: r["n_removed"] for r in repeated_bytes(long).collect()}
    assert gone == {1: 0, 2: len(LONG.encode()), 3: 0}


def test_passages(long, spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["doc_at"]) for r in contaminated(long, bench).collect()}
    at = len(re.findall("[a-z0-9]+", LONG[: LONG.rindex(ITEM)]))
    assert got == {(1, at), (2, at)}


def test_spans_and_scores(long, frame):
    got = {r["doc_id"]: r for r in pii.personal_data(long).collect()}
    assert got[1]["n_email"] == 1 and f"email:{LONG.index('a.b@')}:" in got[1]["spans"]
    got = {r["doc_id"]: r for r in secrets.secret_spans(long, secrets.fit(frame([prose(1, 300)]))).collect()}
    assert got[1]["n_assign"] == 1 and f"assign:{LONG.index('token =')}:" in got[1]["spans"]
    word = np.frombuffer(b"wretch", np.uint8)
    model = toxicity.Model(words_of(word, np.array([0, 6]), lower=True, letters=True).hashes, np.array([3.0]), -0.1, 1.0, Logistic(np.zeros(2), np.ones(2), np.array([1.0, 0.0, 0.0])))
    assert {r["doc_id"]: r["best_score"] for r in toxicity.toxicity_scores(long, model).collect()} == {1: 6.0, 2: 6.0, 3: 0.0}
    sizes = quality_classifier.Model(b"good " * 50, b"bad " * 50, Logistic(np.zeros(1), np.ones(1), np.array([1.0, 0.0])))
    assert quality_classifier.quality_scores(long, sizes).where("score between 0 and 1").count() == 3
    forest = quality_rules.fit(frame([]), frame([]).selectExpr("doc_id", "1 as label"))
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality_verdicts(long, forest).collect()}[1] == len(re.findall(r"[^\x20\x09-\x0d]+", LONG))


def test_pages_and_pieces(long, spark):
    page = "<html><body><article>" + "".join(f"<p>{prose(k, 40)}</p>" for k in range(8000)) + "</article></body></html>"
    text = html_text.extracted(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert text.count("\n") == 7999 and len(page) > 2_000_000
    rows = packing.packed(long).collect()
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in (1, 2, 3)} == {r["doc_id"]: r["doc_tokens"] for r in rows}


def test_divergence_search_and_model(long, spark):
    from pyspark.sql import functions as F

    named = long.withColumn("lang", F.lit("en")).withColumn("source", F.concat(F.lit("s"), "doc_id"))
    got = {(r["source"], r["item"]): r["value"] for r in divergences(named, least=1).where("part = 'pair'").collect()}
    assert len(got) == 6 and got["s1", "s2"] == got["s2", "s1"] < got["s1", "s3"]
    found = [(r["doc_id"], r["rank"]) for r in ranked(indexed(long), spark.createDataFrame([(1, "wretch the end")], "item_id long, text string")).orderBy("rank").collect()]
    assert found == [(2, 1), (1, 2)]
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter()
    for i, t in ((1, LONG), (2, LONG + "the end"), (3, "short")):
        if i not in held:
            counts.update([*re.findall(r"[^\x20\x09-\x0d]+", t.lower()), ""])
    total, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    r = {x["doc_id"]: x for x in language_scores(long).collect()}
    words = [*re.findall(r"[^\x20\x09-\x0d]+", LONG.lower()), ""]
    assert (r[1]["n_tokens"], r[1]["train_tokens"]) == (len(words), total)
    assert math.isclose(r[1]["base_score"], sum(math.log10((counts[w] + 0.5) / scale) for w in words), rel_tol=1e-9)
    assert r[1]["base_score"] < r[1]["score"] < 0
