"""Quality rules, near-duplicates, decontamination, secrets and packing, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import quality_rules, secrets
from lodestar.llm.common import saved, table, training_labels
from lodestar.llm.decontaminate import contaminated
from lodestar.llm.near_dedup import near_duplicates
from lodestar.llm.packing import packed


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a number for every row, ``_name``: its doc_id, or where that is null one made of its text, from 2**62 on."""
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn("_name", F.coalesce(F.col("doc_id").cast("long"), own))


def _without(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``find``, given (doc_id, text), doesn't return the doc_id of; all their columns as they were."""
    named = _named(docs)
    gone = find(named.select(F.col("_name").alias("doc_id"), "text")).select(F.col("doc_id").alias("_gone")).distinct()
    return named.join(gone, named["_name"] == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Each row is judged by its own text, also repeated rows and those without a doc_id; null,
    empty and blank texts have too few words and go; very long texts are read whole, one at a
    time.  Extra columns stay; an empty table gives an empty result.  Scores at the cut are
    rejected.
    """
    forest = quality_rules.fit(docs, training_labels(spark, sf_dir, "quality"))
    return quality_rules.passing(docs, forest)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one of smallest doc_id.

    Rows without a doc_id are named by their text and come after those with one, so that
    copies among them go too.  Of
    repeated rows (one doc_id and text) one stays; null and blank texts are like nothing but
    their own repetition.  Texts of any length are compared whole.  Extra columns stay, those
    of repeated rows from any one of them; an empty table gives an empty result.
    """
    kept = _without(docs, lambda d: near_duplicates(d, words=5, percent=80).where("not kept"))
    return kept.withColumn("_text", F.xxhash64("text")).dropDuplicates(["_name", "_text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; all rows of a doc_id go if one of its texts has one.

    Rows without a doc_id are named by their text.  Null, empty and blank texts stay, repeated
    rows share their fate, texts of any length are searched whole, extra columns stay; an
    empty table or benchmark removes nothing.
    """
    return _without(docs, lambda d: contaminated(d, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets masked in text, and n_chars to match.

    Null texts stay null; repeated rows, rows without a doc_id and texts of any length are
    masked each for itself; extra columns stay; an empty table gives an empty result.
    """
    return secrets.masked(docs, secrets.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    Null and empty texts are their end mark alone; repeated rows are packed each for itself, a
    null doc_id stays null; long texts make many pieces; of equally near neighbours the one
    of smaller doc_id comes first.  Extra columns are ignored; an empty table gives an empty
    result.
    """
    return packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Model scores, sketches and token ids decide in the stages; SQL has no equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
