"""Nearest matches: the offset search between two signatures, its confidence, nearest anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offset_scores(pairs: DataFrame, radius: int, min_overlap: int, predicted: int = 0, alpha: float = 0.0, key: str = "vec_id") -> DataFrame:
    """For each pair of one-dimensional signatures (arrays ref and cur) and each offset p: overlap, sad and score.

    sad is the mean absolute difference over the overlap, score adds ``alpha`` per step from the predicted offset.
    All in one expression per offset, without a join.
    """
    rows = pairs.select(key, "cur", "ref", F.explode(F.sequence(F.lit(predicted - radius), F.lit(predicted + radius))).alias("p"))
    rows = rows.withColumn("lo", F.greatest(F.lit(0), -F.col("p"))).withColumn("hi", F.least(F.size("cur"), F.size("ref") - F.col("p")))
    rows = rows.withColumn("overlap", F.col("hi") - F.col("lo")).where(F.col("overlap") >= min_overlap)
    total = F.expr("aggregate(zip_with(slice(cur, lo + 1, overlap), slice(ref, lo + p + 1, overlap), (a, b) -> abs(a - b)), 0D, (s, x) -> s + x)")
    rows = rows.withColumn("sad", total / F.col("overlap"))
    return rows.select(key, F.col("p").cast("int").alias("p"), F.col("overlap").cast("int").alias("overlap"), "sad", (F.col("sad") + alpha * F.abs(F.col("p") - predicted)).alias("score"))


def best_offsets(scores: DataFrame, key: str = "vec_id") -> DataFrame:
    """The offset with the smallest score, the lowest of equals."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.round("score", 12), "p"))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def confidence(scores: DataFrame, apart: int = 3, key: str = "vec_id") -> DataFrame:
    """The smallest score more than ``apart`` from the best, over the best (infinite if that is about 0)."""
    best = best_offsets(scores, key).select(key, F.col("p").alias("best_p"), F.col("score").alias("best"))
    other = scores.join(best, key).where(F.abs(F.col("p") - F.col("best_p")) > apart)
    ratio = F.when(F.first("best") <= 1e-6, F.lit(float("inf"))).otherwise(F.min("score") / F.first("best"))
    return other.groupBy(key).agg(ratio.alias("confidence"))


def nearest_anchor(frames: DataFrame, anchors: DataFrame, key: str, position: str) -> DataFrame:
    """Per frame the anchor (with its bias) that is nearest by position, the first of equals: i, anchor, far.

    An as-of search from both sides: frames and anchors are laid out by position in one window per key and bias.
    """
    biases = anchors.select(key, "bias").distinct()
    asked = frames.select(key, F.col("i"), F.col(position).alias("y")).join(biases, key)
    both = asked.select(key, "bias", "y", "i", F.lit(None).cast("long").alias("anchor")).unionByName(anchors.select(key, "bias", F.col(position).alias("y"), F.lit(None).cast("long").alias("i"), F.col("i").cast("long").alias("anchor")))
    # of anchors at one position the first counts
    first = F.min("anchor").over(W.partitionBy(key, "bias", "y"))
    both = both.withColumn("here", first)
    by = W.partitionBy(key, "bias").orderBy("y")
    spot = F.when(F.col("here").isNotNull(), F.struct("y", "here"))
    both = both.withColumn("below", F.last(spot, True).over(by.rangeBetween(W.unboundedPreceding, 0))).withColumn("above", F.first(spot, True).over(by.rangeBetween(0, W.unboundedFollowing)))
    options = F.array(*[F.when(F.col(c).isNotNull(), F.struct((F.abs(F.col("y") - F.col(f"{c}.y")) + F.col("bias")).alias("far"), F.col(f"{c}.here").alias("anchor"))) for c in ("below", "above")])
    found = both.where("i IS NOT NULL").select(key, "i", F.array_min(F.filter(options, lambda x: x.isNotNull())).alias("m"))
    return found.groupBy(key, "i").agg(F.min("m").alias("m")).select(key, "i", F.col("m.anchor").alias("anchor"), F.col("m.far").cast("long").alias("far"))


def with_previous(ids: DataFrame, key: str, span: int = 65_536) -> DataFrame:
    """``ids`` (one long column ``key``) with ``prev``, the next smaller one, where there is one.

    Windows are over ranges of ``span`` numbers; only the largest of each range, a row a range, is put in one order.
    """
    part = ids.withColumn("part", F.floor(F.col(key) / span))
    ends = part.groupBy("part").agg(F.max(key).alias("end")).withColumn("before", F.lag("end").over(W.orderBy("part")))
    near = part.withColumn("near", F.lag(key).over(W.partitionBy("part").orderBy(key)))
    return near.join(ends, "part").select(key, F.coalesce("near", "before").alias("prev")).where("prev IS NOT NULL")
