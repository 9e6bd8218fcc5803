"""Connected components of a distributed edge list by alternating large and small stars.

A large-star step links every larger neighbour of a node to the smallest of its neighbourhood, a
small-star step does the same for the smaller neighbours and the node itself. Both keep the
components and shorten paths, so the edges become stars around the smallest node after a number
of rounds that grows with the logarithm of the longest path. Edges that are such stars already cost
one count and no round. Each step is written to the shared
folder: that cuts the lineage, and lets the join of a popular node with its minimum be split,
since both sides are then plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored


def _star(edges: DataFrame, neighbours: DataFrame, path: str, large: bool) -> DataFrame:
    low = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    low = stored(low, f"{path}/low")
    linked = neighbours.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return stored(out.where("u != v").distinct(), f"{path}/edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (``u``, ``v``, any ordered type).

    Edges may repeat, run either way and be loops; null ends are left out. A node that is the
    smallest of its component is there, too; nodes with loops only are not.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "components")
    now = stored(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        f"{path}/0",
    )

    def done(e: DataFrame) -> bool:
        """Whether every node has at most one smaller neighbour, and none that has one is another's."""
        ends = [e.select(F.col(c).alias("node"), *(F.lit(int(c == k)).alias(k) for k in ("u", "v"))) for c in ("u", "v")]
        nodes = ends[0].unionByName(ends[1]).groupBy("node").agg(F.sum("u").alias("n"), F.max("v").alias("root"))
        return not nodes.agg(F.coalesce(F.bool_or((F.col("n") > 1) | (F.col("n") > 0) & (F.col("root") > 0)), F.lit(False))).first()[0]

    step = 0
    while not done(now):
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(now, both, f"{path}/{step}a", large=True)
        now = _star(now, now, f"{path}/{step}b", large=False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
