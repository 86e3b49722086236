"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and two aggregations on node ids; no neighbourhood is ever collected, so a node with
very many neighbours is handled like any other. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.plans.storage import materialize


def _stars(edges: DataFrame, larger_side: bool) -> DataFrame:
    """Reconnect neighbours to the smallest node of a neighbourhood: those above a node (large star) or at most it."""
    if larger_side:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if larger_side:
        moved = pairs.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = (
            pairs.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge: ``root`` is the smallest node that can be reached.

    The steps end when an edge table no longer changes; each node then has one edge, to its root.
    NULL ends and loops are ignored; without edges the result is empty.
    """
    seen, current = None, edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    while True:
        current = materialize(_stars(_stars(current, True), False), "stars")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
