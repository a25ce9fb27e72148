"""Connected components of a link table, by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node it
sees; small-star does the same for the smaller neighbours.  Alternating the
two turns any graph into stars around the smallest node of each component in
a number of rounds logarithmic in the longest path.  Every step is a partial
aggregate and an equi-join, so a hub's neighbours are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return across.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): every node that has a link to
    another node, except each component's smallest, with that smallest node.
    Loops and repeated links are allowed; no links give an empty table."""
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(e)
    while seen[0]:
        e = cut(_small_star(_large_star(e)))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
