"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Moves neighbours to the least neighbour: the larger ones (large star), or the smaller ones (small star)."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    linked = near.join(least, "a")
    moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of the undirected ``edges`` (a, b); component_id is its least node.

    Every round takes a large star and a small star, and ends when no edge changes: then each edge leads from a node
    to the least of its component. The rounds grow with the logarithm of the nodes. Minima are combined before
    their shuffle, and the join has one row per node on one side, a written table, so a hub is a skewed join that Spark
    can split.
    Each round is written to the shared folder. Loops and repeated edges change nothing; no edges give no rows.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        now = cut(_star(_star(now, large=True), large=False))
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionAll(now.select("b", "b")).distinct()


def component_ids(classes: DataFrame, links: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, component_id) of every row of ``classes``: the least ``id_col`` among the classes that ``links`` reach."""
    joined = components(links).select(F.col("id").alias(key), F.col("component_id").alias("c"))
    named = classes.select(key, id_col).join(joined, key, "left").withColumn("c", F.coalesce("c", key))
    least = named.groupBy("c").agg(F.min(id_col).alias("component_id"))
    return named.join(least, "c").select(key, "component_id")
