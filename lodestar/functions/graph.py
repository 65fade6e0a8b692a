"""Connected components of a frame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.shared import cut


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); the component is its least node.

    Alternating large-star and small-star rounds: each node's neighbours are linked to the
    least node around it, until nothing changes; more than ``rounds`` rounds, far above what
    their logarithmic number comes to, are an error.  Minima are aggregated before rows meet.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        edges = cut(large.join(low, "u").select(ends.alias("e")).select("e.*").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    heads = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
