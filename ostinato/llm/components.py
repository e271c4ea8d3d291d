"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """True if each node but the centres has one edge, to its centre."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, most: int = 60, paths: list[str] | None = None) -> DataFrame:
    """(node, component) of every node that has an edge to another node; component is its smallest node.

    Edges stay distributed; each round is two aggregations, and its result is written to the shared
    folder, where that of the round before is then deleted; the last one's folder is added to `paths`.  Loops (a = b) and repeated edges don't matter; an empty list gives an empty result.
    The number of rounds is logarithmic in the size of the largest component.
    """
    own: list[str] = []
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), own)
    for _ in range(most):
        if _is_stars(now):
            if paths is not None:
                paths += own
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, own = own, []
        now = written(_small_star(_large_star(now)), own)
        dropped(edges.sparkSession, before)
    raise RuntimeError(f"no star forest after {most} rounds")
