"""Connected components of a table of links, by alternating large and small stars.

Both steps are an aggregation with partial sums and a join on the node, so a node
with very many links is one row of the aggregate and a splittable join key. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recengine.llm._scratch import materialize


def _settle(links: DataFrame) -> tuple[DataFrame, tuple]:
    """``links`` as a written table, and their number and content hash, which the write itself observes."""
    seen = Observation("links")
    marked = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    table = materialize(marked, "stars")
    return table, (seen.get["n"], seen.get["h"])


def _large(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (u, v); the component is its smallest node.

    Links of a node with itself, repeated and reversed links change nothing.
    Without links there are no rows.
    """
    now, mark = _settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        last = mark
        now, mark = _settle(_small(_large(now)))
        if mark == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
