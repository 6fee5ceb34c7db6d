"""Connected components of a link table, by alternating large-star and small-star joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of `links(a, b)`; the root is the smallest vertex of its component.

    Each round hangs the larger neighbours of a vertex below its smallest one, then the smaller ones, until
    nothing changes; rounds grow with the logarithm of the longest path. Every step is a grouped minimum,
    combined before its shuffle, and a join, so no neighbourhood is gathered anywhere; the written links cut the
    lineage. Loops and repeated links do no harm; without links the result is empty.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = save(links, "links")
    before = None
    while True:
        links = save(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # A star forest: every a hangs below its root b.
    return links.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # Only a neighbour above the vertex moves: links read from their smaller end.
    moved = links.select(F.col("b").alias("v"), F.col("a").alias("w")).join(least.withColumnRenamed("a", "v"), "v")
    return moved.select(F.col("w").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(moved.select("a", F.col("m").alias("b")))
        .where("a > b")
        .distinct()
    )
