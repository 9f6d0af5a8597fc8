"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.runtime import durable

HOT = 512
FEW = 64


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node.

    Each round hangs larger neighbours of a node below its smallest one, then does the
    same for smaller neighbours, until every edge leads to a root; rounds grow with the
    logarithm of the longest path.  Every round is written as a table.  Smallest
    neighbours are partial aggregates; those of nodes with more than 1/512 of all edges
    are brought to the edges by broadcast, so a hub's edges stay where they are.
    """
    now = _ordered(edges)
    now = durable(now, "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = durable(_large_star(now, state[0]), "edges")
        now = durable(_small_star(now, now.count()), "edges")
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return leaves.unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with ``a > b``."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with the facts of ``a``; at most 1,024 hubs go by broadcast."""
    limit = max(total // HOT, FEW)
    hubs = F.broadcast(least.filter(F.col("n") > limit).drop("n"))
    near = edges.join(hubs, "a")
    far = edges.join(hubs.select("a"), "a", "left_anti").join(
        least.filter(F.col("n") <= limit).drop("n"), "a"
    )
    return near.unionByName(far)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(both, least, total).filter("b > a")
    return _ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(edges, least, total)
    return _ordered(
        joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    )
