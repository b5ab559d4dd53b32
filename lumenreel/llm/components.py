"""Connected components by alternating large-star and small-star steps; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import discard, durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v.  Each node's smallest neighbour comes from a partial aggregation, so that a
    node with many edges costs a row per task there; the join that brings it to the edges may be split."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        out = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) of longs: node, component (the smallest node of its component), for nodes that have an edge."""
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        large = durable(_stars(now, True))
        after = durable(_stars(large, False))
        discard(now)
        discard(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionAll(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
