"""Connected components of a graph given as a DataFrame of links, by alternating large and small stars.

Each step sends every neighbour to the smallest node in sight: groups are only ever reduced to a minimum (combined before the
shuffle), and the joins that hand it back have a plain table on both sides, so a node with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """node and component (the smallest node reachable) of each node of links (a, b) that is not its own smallest.

    rows: about the number of links, if known.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = scratch.save(edges, "edges", rows)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * mark[0])
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").filter("far != m").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large", mark[0])
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least", mark[0])
        small = large.join(least, "u").select(F.col("v").alias("u"), "m").filter("u != m").union(least.select("u", "m")).toDF("u", "v").distinct()
        before, edges = edges, scratch.save(small, "edges", 2 * mark[0])
        scratch.drop(before)
        scratch.drop(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
