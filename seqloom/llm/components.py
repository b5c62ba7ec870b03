"""Connected components of a table of links, by labels and shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b long, in either order, repeats allowed).

    Rounds of two steps on star-shaped links: each node's larger neighbours are linked to its smallest neighbour, then all
    its smaller neighbours are. Both keep components as they are, and the number of rounds follows the logarithm of the
    number of nodes. Stops when a round changes nothing. Aggregates are partial before each shuffle, and the joins that
    bring a node's smallest neighbour to its links can be split where a node has very many.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        larger = saved(both.where("v > u").join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low2 = saved(larger.groupBy("u").agg(F.min("v").alias("m")))
        smaller = larger.join(low2.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v")))
        after = saved(smaller.distinct())
        sums = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (edges, after)]
        drop_saved(edges, low, larger, low2)
        edges = after
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
