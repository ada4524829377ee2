"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.session import materialize, release


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge at most that leads down, and none of these ends has one: what
    another round would leave as it is. One shuffle, where such a round takes about eight."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")),
                             F.struct(F.col("b").alias("node"), F.lit(0).alias("down"))))
    nodes = edges.select(ends.alias("_e")).select("_e.*").groupBy("node").agg(
        F.sum("down").alias("n"), F.min("down").alias("least"))
    wrong = (F.col("n") > 1) | ((F.col("n") == 1) & (F.col("least") == 0))
    return nodes.agg(F.count_if(wrong)).first()[0] == 0


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, the node itself included; combines before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node of its component.

    Rounds of large stars (neighbours above a node move to its smallest neighbour) and small stars
    (a node and its neighbours below move to the smallest of them) until all are stars: a number of
    rounds that grows with the logarithm of the nodes. Each round is stored, so a lost executor
    re-reads files. Nulls and loops are dropped; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct()
    now = materialize(now, "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where(F.col("b") > F.col("a")).join(_nearest(both), "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        near = _nearest(large)
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(near.select("a", F.col("m").alias("b")))
        before, now = now, materialize(small.where(F.col("a") != F.col("b")).distinct(), "stars")
        release(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
