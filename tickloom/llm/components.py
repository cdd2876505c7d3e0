"""Connected components over a table of edges, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) for the nodes of edges (a, b), with nodes of one ordered type.

    Large-star and small-star steps (Kiveris et al., 2014): each turns every edge towards the least neighbour, keeps
    the number of edges within bounds and needs O(log^2 n) rounds. A node with many neighbours is only aggregated (min)
    and joined back, never collected. Loops and repeated edges do no harm; rounds end when a step changes nothing.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(edges)
    for _ in range(most_rounds if last[0] else 0):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least one
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        sign = mark(edges)
        if sign == last:
            break
        last = sign
    else:
        if last[0]:
            raise RuntimeError("components did not settle")
    leaves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return leaves.union(edges.select("b", "b").distinct())
