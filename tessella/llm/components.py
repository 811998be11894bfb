"""Connected components by alternating stars: each round is two aggregations and joins, cut by a durable result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours on a node's least one. large: those above the node; else the node and those below it."""
    if large:
        sides = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    if large:
        hung = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = sides.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
    return hung.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id of `pairs` (two long columns, no self-pairs): root is the least id of its component.

    Rounds grow with the logarithm of the longest path. A node with very many neighbours is reduced by partial minima, and its
    rows can be split in the joins."""
    edges = durable(pairs.toDF("u", "v").where("u <> v"))
    seen = None
    while True:
        # Names of a node are moved, never added: the stars keep at most the edges there were.
        edges = durable(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct().toDF("id", "root"))
