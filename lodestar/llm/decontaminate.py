"""Benchmark passages in training documents, found by spaced-seed hashing.

A mask names the token positions of a short span that count; the others may hold any
token.  Test items and documents are hashed under every mask at every position, equal
hashes join, and each hit fixes an alignment of item and document.  The alignments are
then compared token by token.  Only DataFrame functions are used.

Mask 11101 alone has a hit wherever 15 tokens hold at most three substitutions.  Items of
at most ten tokens have room for few hits; where there are any, two more masks make sure
of each alignment that the share admits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import saved

#: Offsets of the tokens that count, the first of them 0.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4), (0, 2, 3, 4))
#: Further masks, used if some item has at most SHORT tokens; items under LEAST tokens aren't looked for.
SHORT_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 1, 3, 4))
SHORT, LEAST = 10, 5
#: Of ``WINDOW`` neighbouring item tokens (all, in shorter items) this share must agree.
WINDOW, SHARE = 15, 0.8
#: Rows and bytes of text up to which a side is sent to all executors; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _seeds(words: str, masks: tuple[tuple[int, ...], ...]) -> Column:
    """An array of (seed, at) over all masks; empty where the text is shorter than a mask."""

    def seed(k: int, mask: tuple[int, ...]):
        return lambda i: F.struct(F.xxhash64(F.lit(k), *(F.get(words, i + o) for o in mask)).alias("seed"), i.alias("at"))

    parts = []
    for k, mask in enumerate(masks):
        last = F.size(words) - mask[-1]
        at = F.when(last >= 1, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, seed(k, mask)))
    return F.concat(*parts)


def _small(df: DataFrame, words: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most BROADCAST_ROWS rows, and its array ``words`` BROADCAST_BYTES bytes.

    All other columns are numbers.
    """
    text = F.octet_length(F.array_join(words, " ")) if words else F.lit(0)
    rows, size = df.select(text.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, doc_at): one row for each leaked item of a document.

    An item is in a document if some ``window`` neighbouring tokens of it (all tokens, if
    it has fewer) agree with the document in ``share`` of the places without insertion or
    deletion.  matched counts the agreeing tokens of the best alignment over the whole
    item, doc_at is that alignment's first token in the document (negative if the item's
    start is cut off); of equal ones the first counts.  Null, empty or blank texts and items of
    fewer than five tokens have no hits; texts of any length are searched whole; repeated
    rows of a document count once, rows with a null doc_id or item_id are compared as any
    other and keep the null.  Other columns are ignored; an empty table on either side gives
    an empty result.
    """
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    item = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.array_compact(tokens(F.col("text"))).alias("item")).where(F.size("item") >= LEAST).distinct()
    masks = MASKS if item.where(F.size("item") <= SHORT).isEmpty() else MASKS + SHORT_MASKS
    item_seeds = item.select("item_id", "item", F.explode(_seeds("item", masks)).alias("s")).select("s.seed", F.xxhash64("item_id", "item").alias("item_key"), F.col("s.at").alias("item_at"))
    seeds = doc.withColumn("words", tokens(F.col("text"))).select("doc_id", "row", F.explode(_seeds("words", masks)).alias("s")).select("doc_id", "row", "s.seed", "s.at")
    hits = seeds.join(_small(item_seeds.distinct()), "seed").select("doc_id", "row", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = saved(hits, "seed_hits")
    hit_rows = hits.select("row").distinct()
    texts = doc.join(_small(hit_rows), "row", "left_semi").dropDuplicates(["doc_id", "row"]).select("row", F.col("doc_id").alias("id"), tokens(F.col("text")).alias("words"))
    keyed = item.withColumn("item_key", F.xxhash64("item_id", "item"))
    pairs = hits.join(texts, (hits["row"] == texts["row"]) & hits["doc_id"].eqNullSafe(texts["id"])).drop(texts["row"]).join(_small(keyed, "item"), "item_key")
    same = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda k: F.when((k + F.col("shift") >= 0) & (F.get("words", k + F.col("shift")) == F.get("item", k)), 1).otherwise(0))
    width = F.least(F.size("item"), F.lit(window))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    pairs = pairs.withColumn("same", same).withColumn("width", width)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("item") - F.col("width") + 1), lambda k: total(F.slice("same", k, F.col("width")))))
    found = pairs.withColumns({"best": best, "matched": total(F.col("same"))}).where(F.col("best") >= F.ceil(F.col("width") * F.lit(share)))
    order = F.struct(F.col("matched"), (-F.col("shift")).alias("back"), F.size("item").alias("size"))
    top = found.groupBy("doc_id", "item_id").agg(F.max(order).alias("top"))
    return top.select("doc_id", "item_id", F.col("top.matched").cast("long").alias("matched"), F.col("top.size").cast("long").alias("item_tokens"), (-F.col("top.back")).cast("long").alias("doc_at"))
