"""Connected components of an edge table, by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")  # a join of two plain shuffles, which Spark can split where a centre is hot
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`id`, `component` (the smallest id that it reaches) for all nodes of edges `a`, `b` but the components' smallest.

    Nodes of one component end as a star around its smallest; the number of rounds grows with the logarithm of the
    components' sizes. Each round is written, so that a lost executor costs no more than that round. Loops, repeated
    edges and empty tables are allowed; nulls are no nodes.
    """
    e = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    while True:
        e = materialize(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count(F.lit(1)), mark).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
