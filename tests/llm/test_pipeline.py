"""The pipeline's stages and the entry module."""

import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).resolve().parent


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), name)
        assert docs.columns == names
        assert 0.6 * before < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_on_odd_rows(odd, spark):
    """All stages on null, empty, blank, long and repeated texts, a null id, and none at all."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "quality_rules":
            assert {r["doc_id"] for r in out.collect()} <= {3, 12, 13}  # the others have under 20 words or one word only
        elif name == "near_dedup":
            assert out.groupBy("doc_id", "text").count().where("count > 1").count() == 0
            assert {r["doc_id"] for r in out.where("doc_id in (3, 12, 13)").collect()} == {3}  # 3 also has the text of 12 and 13
            assert out.where("doc_id is null").count() == 1
        elif name in ("decontamination", "secret_scan"):
            assert out.count() == docs.count()


def test_rows_without_ids(frame, spark):
    """Junk, copies and benchmark passages go also where rows have no doc_id."""
    from pyspark.sql import functions as F

    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    a, b = prose(90, 120), prose(91, 120)
    docs = frame([a, a, a + " more", b, b, passage, "junk"], [None, None, None, 4, None, None, None])
    near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["text"] == b) for r in near if r["text"] != passage and r["text"] != "junk") == [(False, True), (True, False)]
    assert {r["text"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == {a, a + " more", b, "junk"}
    assert "junk" not in {r["text"] for r in corpus_pipeline.quality(spark, docs, SF).collect()}


def test_pipeline_keeps_what_a_plain_version_keeps(frame, spark):
    """The rows of the filtering stages against plain loops over the operators' own definitions."""
    from tests.llm.test_models import brute_statistics
    from tests.llm.test_pairs import brute_components, edited

    base = prose(80, 150)
    texts = [base, edited(base, 2, 1), prose(81, 150), "few words", prose(82, 10) + " " + "again and again " * 40, prose(83, 200)]
    docs = frame(texts)
    forest = corpus_pipeline.quality_rules.Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), int), np.ones((1, 1)), 1.0, 2.0)
    rules = {r["doc_id"] for r in corpus_pipeline.quality_rules.passing(docs, forest).collect()}
    counts = [brute_statistics(t) for t in texts]
    assert rules == {i for i, c in enumerate(counts) if c[0] >= 20 and 100 * c[4] <= 30 * c[0]} == {0, 1, 2, 5}
    roots, _ = brute_components(list(enumerate(texts)), 5)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {i for i, r in roots.items() if i == r}


def test_rest_works_without_the_corpus_operators(tmp_path):
    """Both folders and the pipeline deleted: the entry module imports, and tests of the rest pass."""
    for p in ("lodestar", "tests", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "lodestar" / "llm")
    shutil.rmtree(tmp_path / "tests" / "llm")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, check=True).stdout.split()
    assert int(said[0]) > 40 and said[1:] == ["False", "False"]
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "round_trip or score or csv or similarities or components"], cwd=tmp_path, capture_output=True, text=True, env=env, check=False)
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_all_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}_" for n in range(1, 14)} <= {n[: n.index("_") + 1] for n in entry.queries() if n.startswith("op")}
    assert "pipeline" in entry.queries()
