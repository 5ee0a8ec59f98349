"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _smallest(links: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the smallest v of u; split, should u be hot."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that each can reach.

    Alternates two steps until nothing moves: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. Each
    round at least halves the way to it. Links stay distributed and every
    round is written to the shared checkpoint folder; only a count and a
    checksum reach the driver. Null ends are ignored; no links, no rows."""
    both = (links.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                           F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x"))
            .select("x.*").distinct())
    edges, seen = checkpoint(both), None
    while True:
        # every node tells its larger neighbours of the smallest node around
        near = _smallest(edges.unionByName(edges.select("u", F.col("u").alias("v"))))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # and its smaller neighbours, itself included
        down = large.where("v < u")
        small = _smallest(down)
        star = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        star = checkpoint(star)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            ends = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
        seen = now
        edges = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
