"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, passing_tables, staged

#: Steps grow with the logarithm of the longest path; beyond this something is wrong.
MOST_STEPS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex is either a root or a child of one root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return both.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


#: Vertices of at most so many edges meet theirs by key.
LEAST_HOT = 4096


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) joined with the row that ``least`` (u, m, degree) has for their u; ``n`` bounds the edges.

    Up to ``BROADCAST_KEYS`` edges have no more vertices, so these are broadcast. Of more edges, those of vertices with very many
    are met by a broadcast too, which the limit on the degree keeps to that number; the others by key.
    """
    if n <= BROADCAST_KEYS:
        return edges.join(F.broadcast(least), "u").drop("degree")
    most = max(LEAST_HOT, n // BROADCAST_KEYS)
    hot = F.broadcast(least.filter(F.col("degree") > most))
    rest = edges.join(hot, "u", "left_anti").join(least.filter(F.col("degree") <= most), "u")
    return edges.join(hot, "u").unionByName(rest).drop("degree")


def connected_components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of ``edges`` (a, b): root is the smallest vertex of its component.

    Only per-vertex minima are aggregated, so a vertex with very many edges is never gathered; they meet its
    minimum where they are.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with passing_tables(edges.sparkSession) as lasting:
        return lasting(_settle(staged(e, "edges")), "roots")


def _settle(e: DataFrame) -> DataFrame:
    degree = F.count(F.lit(1)).alias("degree")
    for _ in range(MOST_STEPS):
        if _settled(e):
            break
        n = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("u", "m").alias("m"), "degree")
        large = _with_least(both, least, n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), degree)
        small = _with_least(large, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())
