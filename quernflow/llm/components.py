"""Connected components by alternating large-star and small-star steps.

Edges and labels stay distributed; each round is cut by a written table, which replaces the
one before. A node with many edges (the hub of a large component) does not gather them in one
task: its smallest neighbour is found by partial aggregation and sent to where its edges are.
Nodes may be of any type that can be ordered. The result has a row per node that has an edge: node, component (the smallest
node reachable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernflow.llm.common import hot_join, remove, written


def _signature(edges: DataFrame) -> tuple:
    """Count and an order-free checksum; equal for equal edge sets."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    return tuple(row)


def large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return hot_join(both.where("v > u"), least.where("n > 0"), ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` point from the larger node u to the smaller node v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = hot_join(edges, least, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", most_rows: int | None = None) -> DataFrame:
    """Null ends and loops are ignored; no edges give an empty result. ``most_rows``: a bound of
    the edges, if one is known. Rounds never have more edges than nodes, so than twice the edges."""
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs, path = written(pairs.where(f"{left} IS NOT NULL AND {right} IS NOT NULL").where("u <> v").distinct(), "edges", most_rows)
    before = _signature(pairs)
    while before[0]:
        pairs, stars = written(small_star(large_star(pairs, before[0]), before[0]), "stars", 2 * before[0])
        remove(pairs.sparkSession, path)
        after, path = _signature(pairs), stars
        if after == before:
            break
        before = after
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
