"""Connected components of an edge table, by alternating star operations; no task or driver ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b), component being the smallest node reachable.

    Each round points all larger neighbours of a node, then all smaller ones and itself, to its smallest neighbour, and
    writes the edges, which bounds the lineage; it ends when a round changes nothing. Hubs are pre-aggregated (a minimum
    for each node) and the joins back to the edges are inner joins that skew handling may split.
    """

    def stars(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            sided = e.union(e.select("b", "a"))
        else:
            sided = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sided.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = sided.join(least, "a")
        if larger:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    current = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    # the sum of a hash over the edges tells whether a round changed them
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, k = mark(current), 0
    while before[0]:
        k += 1
        after = work.table(stars(stars(current, True), False), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        now, current = mark(after), after
        if now == before:
            break
        before = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
