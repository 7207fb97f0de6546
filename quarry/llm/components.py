"""Connected components over an edge table: alternating large-star and small-star joins, written out after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, scratch


def _stars(both: DataFrame, keep) -> DataFrame:
    """Connect the neighbours of each node for which ``keep`` holds to the node's least neighbour (itself included)."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``u``, ``root`` for every node of ``edges`` (u, v): root is the least node that it can reach.

    Each round leaves the components as they are and brings them nearer to stars around their least nodes; the number
    of rounds grows with the logarithm of the longest path. A hot centre is an aggregate's group and one side of a
    join, both of which Spark can split.
    """
    with scratch() as keep:
        out = _settled(edges, limit)
        keep(out)
    return out


def _settled(edges: DataFrame, limit: int) -> DataFrame:
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_stars(both, F.col("v") > F.col("u")), "large")
        # Small star: each node's lesser neighbours, and the node itself, to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(before, large)
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            return materialize(now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()), "roots")
        seen = sums
    raise RuntimeError("the components did not settle")
