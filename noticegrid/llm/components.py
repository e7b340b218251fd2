"""Connected components of a table of links, by contraction towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links`` (``a, b``), the component's least id.

    Every round links each vertex to the least of its neighbourhood, first from larger to smaller
    ends, then among the smaller ones. Neighbourhoods are only ever aggregated, never gathered, and
    each round is a written table, so lost executors cost one round at most.
    """
    edges = materialise(_ordered(links.select("a", "b")))
    size = _mark(edges)
    while True:
        # Large star: of each vertex, all larger neighbours are hung on the least of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        edges = _ordered(large)
        # Small star: of each vertex, all smaller neighbours are hung on the least of them.
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        small = edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = materialise(_ordered(small))
        now = _mark(edges)
        if now == size:
            break
        size = now
    roots = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    return roots.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge tables."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
