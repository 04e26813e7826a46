"""Connected components of a links table, as joins and aggregates in rounds.

Each round hangs every vertex's larger neighbours on its smallest one (large
star), then its smaller ones (small star); vertices stay spread over the
cluster and the number of links never grows. Rounds are written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.session import staged

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        .filter("a <> b")
    )


def components(links: DataFrame) -> DataFrame:
    """v, root for every vertex of ``links`` (a, b); the root is the smallest vertex of its component."""
    edges = staged(links.filter("a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        edges = staged(_small_star(_large_star(edges)).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # Settled links hang every vertex on its root.
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    )
