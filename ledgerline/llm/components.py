"""Connected components by alternating large and small stars over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is linked to the least vertex around it."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its neighbours below it are linked to the least of them (links lead downwards)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """vertex, root: every vertex of a link with the least vertex it reaches. Self links are ignored.

    A round costs two aggregates and two joins on a vertex; hubs meet one row of the other side, so adaptive execution
    may split them. Each round is written to the shared folder; the number of rounds grows with the logarithm
    of the longest chain.
    """
    downward = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = staged(downward), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return current.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionAll(
                current.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
        before, current = state, staged(_small_star(_large_star(current)))
