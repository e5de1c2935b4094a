"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import checkpoint, release


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _settled(e: DataFrame) -> bool:
    """Whether all edges (u, v), u > v, form stars around their smallest nodes: no node has two smaller ones, or one and a greater one."""
    ends = e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).filter("up > 0 and n > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link.

    Each round is two joins on the links' ends and cuts its lineage through the shared folder; the
    number of rounds grows with the logarithm of the longest chain, and links that are stars already
    need none. Minima are aggregated before they are shuffled and no node's neighbours are collected,
    so that a node may have any number.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = checkpoint(e)
    for _ in range(rounds):
        if _settled(e):
            break
        low = _both_ways(e).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # e has each node's smaller neighbours, so that its greater ones are in e turned round
        greater = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = greater.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.inline(ends))
        e = checkpoint(small.filter("u <> v").distinct())
        # the files of every round would stay till the end
        release(links.sparkSession)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
