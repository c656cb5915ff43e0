"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import stored


def _sum(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    )


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; the root is the smallest node.

    Each round hangs all larger neighbours of a node on its smallest neighbour
    (large star), then a node and its smaller neighbours on the smallest of them
    (small star).  Minima combine on the map side, so a hub with many links is
    one row a task there; joining its links back is an ordinary equi-join, which
    adaptive execution splits.  Rounds grow with the logarithm of the longest
    path.  Each round is written to the shared folder.
    """
    edges = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = stored(edges.distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = stored(small.select("e.*").where("u <> v").distinct(), "edges")
        after = _sum(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
