"""How the sources of a language differ, by inclusion-exclusion over the terms that they use.

Every group (lang, source) gives every kept term of its language a probability, also the
terms that it never uses.  The distance of two groups is a sum over all kept terms, but
most terms are missing from most groups, so it is put together from three parts:

* *one-sided*: a group's terms, priced as if the other had none of them.  The price of a
  term hangs on its count alone, so a histogram of counts (terms a count) is enough; running
  sums along the histogram price it against all other groups in one ordered pass;
* *both zero*: the terms that neither uses cost the same each, a constant times their number;
* *overlap*: postings (group, term) of the same term meet, and each such pair is corrected
  by what it costs less what the other two parts have charged for it.

No frame of groups times terms is made; pairs of groups are the result itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import chunks, saved, utf8
from lodestar.llm.words import terms_of

#: Documents of its language that a kept term occurs in.
LEAST_DOCS = 30
#: Added to every count; probabilities are parts of SCALE.
PRIOR, SCALE = 5, 1_000_000_000
#: Ranks returned of the terms of a group.
TOP_TERMS = 50
#: Bytes of text whose counts are added up before they leave a task's Python.
COUNT_BYTES = 8 << 20
#: Groups up to which their totals are sent to all executors (a row has under 200 bytes); more are shuffled.
BROADCAST_GROUPS = 100_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a slice of documents: occurrences, and documents with the term."""
    for b in chunks(batches, limit=COUNT_BYTES):
        terms, owner = terms_of(*utf8(b.column("text")))
        coded = terms.dictionary_encode()
        code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
        lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
        width = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + source.indices.to_numpy(zero_copy_only=False)
        once, times = np.unique(owner * size + code, return_counts=True)
        key, back = np.unique(group[once // size] * size + once % size, return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, back, times)
        of = key // size
        columns = [lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)), coded.dictionary.take(pa.array(key % size)), pa.array(n), pa.array(np.bincount(back, minlength=len(key)))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR)
    return F.call_function("div", above, F.nullif(wide(total + PRIOR * terms), F.lit(0).cast("decimal(20,0)"))) + 1


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def divergences(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds each other source of the lang and its distance, part ``term`` the ``top`` terms that the source uses more than its language does.

    Null lang, source and text are ''.  Terms are runs of ASCII letters and of characters
    beyond ASCII, A-Z lower-cased; a language keeps those of at least ``least`` documents.
    Rows are documents: repeated rows count again, a null doc_id is a document like others.
    Texts of any length are read whole.  Groups without terms take part with their prior; a
    language without kept terms has pairs of value 0 and no terms.  Equal values are ranked by
    the item's bytes.  Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    group = ["lang", "source"]
    counted = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = saved(counted.groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    postings = saved(counts.drop("docs").join(kept, ["lang", "term"]), "postings")

    langs = saved(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total")), "lang_totals")
    used = postings.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = own.select(*group).distinct().join(used, group, "left").join(langs, "lang", "left").fillna(0)
    groups = saved(groups.withColumn("zero", probability(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    near = _few(groups, BROADCAST_GROUPS)

    priced = postings.join(near, group).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    best = priced.withColumn("value", F.col("p") - probability(F.col("all_n"), F.col("lang_total"), F.col("terms"))).where("value > 0").withColumnRenamed("term", "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))
    columns = [*group, "item", "value", "rank"]
    top_terms = ranked(best).where(F.col("rank") <= top).select(*columns, F.lit("term").alias("part"))
    return ranked(_pairs(groups, near, postings, priced)).select(*columns, F.lit("pair").alias("part")).unionByName(top_terms).select(*group, "part", "item", F.col("value").cast("long").alias("value"), "rank")


def _pairs(groups: DataFrame, near: DataFrame, postings: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two groups of a lang, in both directions."""
    group = ["lang", "source"]
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("support").alias("item_support"))
    pairs = groups.join(other, "lang").where("source <> item")
    histogram = postings.groupBy(*group, "n").agg(F.count("*").alias("h")).join(near, group)
    bins = histogram.select(*group, probability(F.col("n"), F.col("total"), F.col("terms")).alias("at"), "h", F.lit(None).cast("string").alias("item"))
    points = pairs.where("terms > 0").select(*group, F.col("item_zero").alias("at"), F.lit(0).cast("long").alias("h"), "item")
    whole = Window.partitionBy(*group)
    below = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"h_below": F.sum("h").over(below), "w_below": F.sum(F.col("h") * F.col("at")).over(below), "h_all": F.sum("h").over(whole), "w_all": F.sum(F.col("h") * F.col("at")).over(whole)}
    cost = F.col("at") * (2 * F.col("h_below") - F.col("h_all")) + F.col("w_all") - 2 * F.col("w_below")
    one_sided = bins.unionByName(points).withColumns(sums).where("item is not null").select(*group, "item", cost.alias("own_cost"))
    other_sided = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own_cost").alias("item_cost"))

    a = priced.select("lang", "term", "source", "p", "zero")
    b = a.select("lang", "term", *(F.col(c).alias(f"item_{c}") for c in ("source", "p", "zero")))
    correction = F.abs(F.col("p") - F.col("item_p")) - F.abs(F.col("p") - F.col("item_zero")) - F.abs(F.col("item_p") - F.col("zero")) + F.abs(F.col("zero") - F.col("item_zero"))
    shared = a.join(b, ["lang", "term"]).where("source < item_source").groupBy("lang", "source", "item_source").agg(F.sum(correction).alias("correction"))
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("source", "item_source"), ("item_source", "source"))))
    shared = shared.select("lang", F.explode(ways).alias("way"), "correction").select("lang", "way.*", "correction")
    ends = [*group, "item"]
    both_zero = (F.col("terms") - F.col("support") - F.col("item_support")) * F.abs(F.col("zero") - F.col("item_zero"))
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("own_cost", "item_cost", "correction")), F.coalesce(both_zero, F.lit(0)))
    return pairs.join(one_sided, ends, "left").join(other_sided, ends, "left").join(shared, ends, "left").select(*ends, value.alias("value"))
