"""Connected components of an edge table, by large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.explode(F.array(F.struct("b", "least"), F.struct(F.col("a").alias("b"), "least"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.least").alias("b")).where("a <> b").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(a, b): each node a that is not its component's least node, and that least node b.

    edges: columns a and b of one comparable type, without nulls. Each round is written to the shared folder;
    it ends when a round changes nothing.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last or not now[0]:
            return edges
        last = now
        edges = written(_small_star(_large_star(edges)), "edges")
