"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialize, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); the component is its smallest node.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones; the number
    of rounds grows with the logarithm of the longest path. Edges are written after each round and never come to
    the driver; the smallest neighbour is aggregated map-side. The smallest neighbours of up to BROADCAST_ROWS nodes are
    sent to every task, so that edges of a node with many aren't gathered; of more nodes, AQE splits such joins.
    Self loops keep single nodes. Null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    nodes = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    stars = materialize(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    def few(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small_graph else table

    small_graph = nodes.count() <= BROADCAST_ROWS
    before = None
    for _ in range(max_rounds):
        both = stars.union(stars.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("other > node").join(few(least), "node").select(F.col("m").alias("low"), F.col("other").alias("high")).where("low <> high").distinct()
        small_least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        small = (
            large.join(few(small_least), F.col("high") == F.col("node"))
            .select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high"))
            .where("low <> high")
            .distinct()
        )
        spent, stars = stars, materialize(small, "edges")
        release(spent)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
