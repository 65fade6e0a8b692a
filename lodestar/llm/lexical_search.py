"""Ranked lexical search with block-max pruning.

The index is a table with a row a block, a block being up to ``BLOCK_DOCS`` neighbouring
documents.  A row has two parts in columns of their own, so that each is read without the
other: the *head*, the block's terms with the number of its documents that hold each and
the largest part of a score that the term can add there; and the *forward index*, each
document's terms and frequencies.

A search sums a query's weighted maxima to a bound of each block, takes the blocks with the
highest bounds, scores their documents, and goes on, in steps that grow, with those blocks
whose bound isn't below the tenth best score found by then.  Blocks below it are never
scored, and no better document can be in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, lists, saved, utf8
from lodestar.llm.words import word_counts, words_of

#: Documents of a block, and bytes of text of a slice that is cut into blocks; a longer text is a block alone.
BLOCK_DOCS, SLICE_BYTES = 64, 2 << 20
#: Blocks of a row group of the index: what a reader holds at once.
GROUP_BLOCKS = 16
#: Best blocks of a query that the first steps score; the last step takes all that are left.
STEPS = (4, 64)
#: (query, term) rows that are searched for together; more queries are searched for in several parts.
BATCH_TERMS = 1 << 18
#: (query, block) rows up to which a step's choice is sent to all executors (12 bytes each); a larger one is shuffled.
BROADCAST_CHOICE = 2_000_000

_HEAD = "block long, terms array<long>, tops array<long>, dfs array<long>"
_SCHEMA = f"{_HEAD}, doc_ids array<long>, lengths array<long>, sizes array<int>, codes array<int>, tfs array<int>"


@dataclass
class Index:
    """blocks: the table; documents: those with a term; tokens: all terms with repeats."""

    blocks: DataFrame
    documents: int
    tokens: int


def gain(tf: np.ndarray, length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight; it grows with tf and shrinks with the text's length."""
    m = 10 + (90 * length * documents) // max(tokens, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, limit=SLICE_BYTES):
        n = word_counts(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "tokens"])


def _blocks(documents: int, tokens: int, block_docs: int):
    """Documents as rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for b in chunks(batches, limit=SLICE_BYTES):
            words = words_of(*utf8(b.column("text")), lower=True, letters=True, digits=True)
            n = len(b)
            length = np.diff(words.first)
            vocabulary, code = np.unique(words.hashes.view(np.int64), return_inverse=True)
            width = max(len(vocabulary), 1)
            posting, tf = np.unique(words.owner() * width + code, return_counts=True)
            doc, term = posting // width, posting % width
            head, local = np.unique(doc // block_docs * width + term, return_inverse=True)
            top = np.zeros(len(head), np.int64)
            np.maximum.at(top, local, gain(tf, length[doc], documents, tokens))
            count = -(-n // block_docs)
            heads = np.bincount(head // width, minlength=count)
            first = np.cumsum(heads) - heads
            docs = np.minimum(block_docs, n - np.arange(count) * block_docs)
            postings = np.bincount(doc // block_docs, minlength=count)
            ids = b.column("doc_id")
            offsets = pa.array(np.append(0, np.cumsum(docs)).astype(np.int32))
            columns = [
                pa.array(made + np.arange(count)),
                lists(vocabulary[head % width], heads),
                lists(top, heads),
                lists(np.bincount(local, minlength=len(head)), heads),
                pa.ListArray.from_arrays(offsets, ids),
                lists(length.astype(np.int64), docs),
                lists(np.bincount(doc, minlength=n).astype(np.int32), docs),
                lists((local - first[doc // block_docs]).astype(np.int32), postings),
                lists(tf.astype(np.int32), postings),
            ]
            made += count
            yield pa.RecordBatch.from_arrays(columns, _SCHEMA.replace(",", "").split()[::2])

    return run


def indexed(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of all rows of ``docs`` (doc_id, text), written to the shared folder.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, kept
    as 64-bit hashes.  Two words of one hash would count as one term: 1 in 3 * 10**9 for 5000
    words of queries among 10**7 of documents.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = own.select("text").mapInArrow(_totals, "documents long, tokens long").agg(F.sum("documents"), F.sum("tokens")).first()
    documents, tokens = got[0] or 0, got[1] or 0
    blocks = own.mapInArrow(_blocks(documents, tokens, block_docs), _SCHEMA)
    return Index(saved(blocks, "lexical_blocks", **{"parquet.block.row.count.limit": GROUP_BLOCKS}), documents, tokens)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        words = words_of(*utf8(b.column("text")), lower=True, letters=True, digits=True)
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(words.owner())), pa.array(words.hashes.view(np.int64))], ["item_id", "term"])


@dataclass
class Queries:
    """A part of the queries: the terms of all, ascending; for each (query, term) row the numbers of both and the weight."""

    names: list
    terms: np.ndarray
    term: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def scored(columns: tuple[np.ndarray, ...], wanted: np.ndarray, queries: Queries, index: tuple[int, int], least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document's place in the block, score): of each wanted query the ``top`` best documents of a block with at least the score ``least``."""
    terms, lengths, sizes, codes, tfs, ids = columns
    at = np.searchsorted(terms, queries.terms)
    at[at == len(terms)] = 0
    there = terms[at] == queries.terms if len(terms) else np.zeros(len(at), bool)
    asked = np.zeros(len(queries.names), bool)
    asked[wanted] = True
    use = np.flatnonzero(asked[queries.query] & there[queries.term])
    order = np.argsort(codes, kind="stable")
    many = np.bincount(codes, minlength=len(terms))
    first = np.cumsum(many) - many
    code = at[queries.term[use]]
    n = many[code]
    entry = np.repeat(np.arange(len(use)), n)
    posting = order[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(len(entry))]
    doc = np.repeat(np.arange(len(sizes)), sizes)[posting]
    parts = queries.weight[use][entry] * gain(tfs[posting].astype(np.int64), lengths[doc], *index)
    key, back = np.unique(queries.query[use][entry] * len(sizes) + doc, return_inverse=True)
    score = np.zeros(len(key), np.int64)
    np.add.at(score, back, parts)
    query, doc = key // len(sizes), key % len(sizes)
    fit = (score > 0) & (score >= least[query])
    query, doc, score = query[fit], doc[fit], score[fit]
    by = np.lexsort((ids[doc], -score, query))
    query, doc, score = query[by], doc[by], score[by]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < top], doc[rank < top], score[rank < top]


def _scores(queries: Queries, index: tuple[int, int], least: np.ndarray, top: int):
    """Blocks, with the queries that want each, as the best documents of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                row = {c: b.column(c)[k].values for c in ("terms", "lengths", "sizes", "codes", "tfs", "doc_ids", "wanted")}
                ids = row["doc_ids"]
                order = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                plain = (row[c].to_numpy(zero_copy_only=False) for c in ("terms", "lengths", "sizes", "codes", "tfs"))
                query, doc, score = scored((*plain, order), row["wanted"].to_numpy(), queries, index, least, top)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids.take(pa.array(doc)), pa.array(score)], ["query", "doc_id", "score"])

    return run


def _searched(index: Index, terms: DataFrame, top: int, steps: tuple[int, ...]) -> DataFrame:
    """The best documents of the queries of ``terms`` (item_id, term), few enough for the driver."""
    spark = terms.sparkSession
    named = [(r["item_id"], r["term"]) for r in terms.distinct().collect()]
    names = sorted({i for i, _ in named}, key=lambda i: (i is None, i))
    number = {name: k for k, name in enumerate(names)}
    asked = spark.createDataFrame([(number[i], t) for i, t in named], "query int, term long")
    heads = index.blocks.select("block", F.explode(F.arrays_zip("terms", "tops", "dfs")).alias("h")).select("block", F.col("h.terms").alias("term"), F.col("h.tops").alias("most"), F.col("h.dfs").alias("df"))
    heads = saved(heads.join(F.broadcast(asked.select("term").distinct()), "term"), "block_heads")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    weights = {r["term"]: r["w"] for r in heads.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("w")).collect()}
    rows = np.array(sorted((t, number[i], weights[t]) for i, t in named if t in weights), np.int64).reshape(-1, 3)
    known, place = np.unique(rows[:, 0], return_inverse=True)
    queries = Queries(names, known, place, rows[:, 1], rows[:, 2])
    weighted = spark.createDataFrame(pa.table({"query": pa.array(rows[:, 1], pa.int32()), "term": rows[:, 0], "weight": rows[:, 2]}))
    bounds = saved(heads.join(F.broadcast(weighted), "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).where("bound > 0"), "bounds")

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    state = {"least": np.zeros(len(names), np.int64), "bound": np.full(len(names), np.iinfo(np.int64).max), "block": np.full(len(names), -1, np.int64)}
    found = None
    for step in (*steps, None):
        now = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(names)), pa.int32()), **state}))
        left = bounds.alias("b").join(F.broadcast(now.alias("s")), "query").where("b.bound >= s.least and (b.bound < s.bound or b.bound = s.bound and b.block > s.block)").select("query", "b.block", "b.bound")
        if step:
            left = left.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("r") <= step).drop("r")
        chosen = saved(left, "chosen_blocks")
        size = chosen.count()
        if not size:
            break
        by_block = chosen.groupBy("block").agg(F.collect_list("query").alias("wanted"))
        blocks = index.blocks.drop("tops", "dfs").join(F.broadcast(by_block) if size <= BROADCAST_CHOICE else by_block, "block")
        fresh = blocks.drop("block").mapInArrow(_scores(queries, (index.documents, index.tokens), state["least"], top), "query int, doc_id long, score long")
        every = fresh if found is None else fresh.unionByName(found)
        found = saved(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank"), "best_documents")
        if step:
            for r in found.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == top).collect():
                state["least"][r["query"]] = r["least"]
            for r in chosen.groupBy("query").agg(F.min(F.struct(F.col("bound"), (-F.col("block")).alias("back"))).alias("last")).collect():
                state["bound"][r["query"]], state["block"][r["query"]] = r["last"]["bound"], -r["last"]["back"]
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    item = spark.createDataFrame(list(enumerate(names)), "query int, item_id long")
    return found.withColumn("rank", F.row_number().over(best)).join(F.broadcast(item), "query").select("item_id", "rank", "doc_id", "score")


def ranked(index: Index, queries: DataFrame, top: int = 10, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each of ``queries`` (item_id, text), best first.

    Equal scores go by doc_id, rows without one last.  Rows of the index are documents, repeated
    rows as well; rows of one item_id (null is one) are one query of all their terms.  Null, empty and
    blank texts have no terms: such documents are never found, such queries find nothing, as
    do queries without a term in common with any document.  Texts of any length count as a
    whole.  An empty table on either side gives an empty result; other columns are ignored.
    """
    own = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = saved(own.mapInArrow(_query_terms, "item_id long, term long").distinct(), "query_terms")
    parts = max(1, -(-terms.count() // BATCH_TERMS))
    found = [_searched(index, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k), top, steps) for k in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
