"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b, longs) -> (node, component): the smallest node reachable from each node that has an edge.

    Each round joins the edges with one minimum per node; nodes with very many edges, such as the stars that grow around a
    minimum, leave the shuffle (``join_frequent``). Nulls and loops are ignored. Every round is written to shared storage,
    in place of the one before.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.select("u", F.least("u", "m").alias("m"), "n")
        large = join_frequent(both.where("v > u"), low, "u", "n", 2 * state[0])
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_frequent(large, low, "u", "n", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(e, large)
        before, e, state = state, new, _state(new)
        if before == state:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
