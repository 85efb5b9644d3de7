"""Connected components over links, as DataFrame joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

#: Edges of one task. Steps are many and their data small, so they must not run in as many tasks as
#: the session has shuffle partitions; each of these would leave its files for each of the steps.
EDGES = 100_000

# Merge hints: edges are shuffled anyway, and a broadcast would pass through the driver in each step.


def connected_components(links: DataFrame) -> DataFrame:
    """`links` has columns a and b (long); returns node and component, the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change. A step moves
    each node's edges to the smallest neighbour; both take one aggregate and one join of the edges,
    and no node's neighbours are ever gathered in one row. Nodes without links are not returned.
    """

    def symmetric(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large_star(e: DataFrame) -> DataFrame:
        both = symmetric(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.union(low.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    parts = 1 + links.count() // EDGES
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").coalesce(parts)
    edges = pin(edges.distinct().coalesce(parts))
    before = mark(edges)
    while before[0]:
        moved = small_star(large_star(edges).coalesce(parts)).coalesce(parts)
        edges = pin(moved.distinct().coalesce(parts))
        now = mark(edges)
        if now == before:
            break
        before = now
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(parts))
