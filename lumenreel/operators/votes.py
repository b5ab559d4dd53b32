"""Cross-frame statistics: position bins and prevalence, pixel aggregates with layered fallbacks, colour counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_of(value: Column, size: float) -> Column:
    """Floor division, also for negative values."""
    return F.floor(value / size).cast("long")


def persistent(found: DataFrame, frame: str, x: str, y: str, r: str, frames: int, size: int = 8, prevalence: float = 0.4) -> DataFrame:
    """Bins that many frames vote for: one vote per frame and bin (its first hit), at least ``max(1, ceil(prevalence * frames))``."""
    binned = found.withColumn("bx", bin_of(F.col(x), size)).withColumn("by", bin_of(F.col(y), size))
    first = F.row_number().over(W.partitionBy(frame, "bx", "by").orderBy("hit"))
    votes = binned.withColumn("_n", first).where("_n = 1")
    out = votes.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("votes"), F.median(r).alias("r_median"), F.min(r).alias("r_min"), F.max(r).alias("r_max"))
    return out.where(F.col("votes") >= max(1, math.ceil(prevalence * frames)))


def census(found: DataFrame, x: str, y: str, r: str, size: int = 8) -> DataFrame:
    """Counts per (x, y, r) bin and per (x, y) bin in one pass, with radius statistics."""
    binned = found.select(bin_of(F.col(x), size).alias("bx"), bin_of(F.col(y), size).alias("by"), bin_of(F.col(r), size).alias("br"), F.col(r).alias("r"))
    out = binned.groupingSets([["bx", "by", "br"], ["bx", "by"]], "bx", "by", "br")
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.avg("r").alias("r_mean"))


def clean_mean(value: Column, clean: Column) -> Column:
    """Mean of the clean samples, truncated to a whole number; null without any."""
    return F.avg(F.when(clean, value)).cast("int")


def gated_median(value: Column, clean: Column, tolerance: float | None = None) -> Column:
    """Where no sample is clean: the median of all, truncated; with a tolerance, only of two samples or more within it."""
    median = F.median(value).cast("int")
    if tolerance is not None:
        median = F.when((F.count(value) >= 2) & (F.max(value) - F.min(value) <= tolerance), median)
    return F.when(F.count_if(clean) == 0, median)


def agreement(df: DataFrame, place: list[str], value: str, tolerance: float = 12, share: float = 0.6, least: int = 4) -> DataFrame:
    """Per place: samples, their median, the share within the tolerance of it, and whether that reaches ``share``."""
    median = df.groupBy(*place).agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    joined = df.join(median, place)
    out = joined.groupBy(*place, "median", "n").agg(F.count_if(F.abs(F.col(value) - F.col("median")) <= tolerance).alias("near"))
    return out.withColumn("agree", F.col("near") / F.col("n")).withColumn("masked", F.col("agree") >= share).drop("near")


def packed(red: Column, green: Column, blue: Column) -> Column:
    """A colour as one number."""
    return F.shiftleft(red.cast("long"), 16).bitwiseOR(F.shiftleft(green.cast("long"), 8)).bitwiseOR(blue.cast("long"))


def unpacked(colour: Column) -> Column:
    part = lambda k: F.shiftright(colour, k).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def mode_of(colour: Column) -> Column:
    """The commonest value, the smallest of equals."""
    return F.mode(colour, True)


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` commonest values: a report of fixed length, ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def distance_histogram(df: DataFrame, distance: Column, width: float) -> DataFrame:
    """bucket, n, and the cumulative percentage up to it."""
    counts = df.groupBy(bin_of(distance, width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    run, whole = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return counts.withColumn("cum_pct", F.round(100 * F.sum("n").over(run) / F.sum("n").over(whole), 6))


def exact_quantile(df: DataFrame, value: str, q: float, held: int = 100_000) -> Column:
    """The quantile of ``value`` (interpolated) as a literal; null if there is no value.

    Approximate quantiles bracket its place until at most ``held`` values are left, which are then looked at exactly, so
    no task holds all distinct values.
    """
    inside = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = size = inside.count()
    if not n:
        return F.lit(None).cast("double")
    place, below = q * (n - 1), 0
    while size > held:
        share = (place - below) / size
        low, high = inside.agg(F.percentile_approx("v", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)).first()[0]
        less, kept = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below + less <= place or not place + 1 <= below + less + kept - 1 or kept == size:
            break  # ties or the ends: what is left is small already, or of few distinct values
        inside, below, size = inside.where(F.col("v").between(low, high)), below + less, kept
    return F.lit(inside.agg(F.percentile("v", (place - below) / max(1, size - 1))).first()[0])
