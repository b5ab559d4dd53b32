"""Coverage of canvas rows by placed bands: counts by a sweep of starts and ends, classes, zones, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(placed: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Stretches of equal coverage: y0, y1 (exclusive), cover.  +1 and -1 events and a running sum; no range join."""
    events = placed.select(key, F.col(start).alias("y"), F.lit(1).alias("e")).unionAll(placed.select(key, F.col(end).alias("y"), F.lit(-1).alias("e")))
    steps = events.groupBy(key, "y").agg(F.sum("e").alias("e"))
    by = W.partitionBy(key).orderBy("y")
    steps = steps.withColumn("cover", F.sum("e").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("y1", F.lead("y").over(by))
    return steps.where("y1 IS NOT NULL").select(key, F.col("y").alias("y0"), "y1", F.col("cover").cast("long").alias("cover"))


def rows(placed: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Coverage of each canvas row from the first to the last: y, cover (0 in holes)."""
    return segments(placed, key, start, end).select(key, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "cover")


def support(cover: Column) -> Column:
    return F.when(cover == 0, "gap").when(cover == 1, "weak").otherwise("ok")


def classes(placed: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows of each support class per key."""
    parts = segments(placed, key, start, end).withColumn("support", support(F.col("cover")))
    return parts.groupBy(key, "support").agg(F.sum(F.col("y1") - F.col("y0")).cast("long").alias("n_rows"))


def zones(placed: DataFrame, key: str, start: str, end: str, most: int) -> DataFrame:
    """Maximal stretches covered at most ``most`` times: y0, y1 (inclusive)."""
    parts = segments(placed, key, start, end).withColumn("low", F.col("cover") <= most)
    by = W.partitionBy(key).orderBy("y0")
    new = F.when(F.col("low") & F.coalesce(F.lag("low").over(by), F.lit(False)), 0).otherwise(1)
    parts = parts.withColumn("g", F.sum(new).over(by)).where("low")
    return parts.groupBy(key, "g").agg(F.min("y0").alias("y0"), (F.max("y1") - 1).alias("y1")).drop("g")


def overlapping(placed: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Windows (w0, w1) and the placements (y0, y1) that overlap them, by bins of the common length.

    Both sides name the bins that they touch, so it is an equi-join; a pair counts in the first bin that both touch.
    """
    size = 512
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))).alias("bin")
    left = placed.select("*", bins("y0", "y1"))
    right = windows.select("*", bins("w0", "w1"))
    met = left.join(right, [key, "bin"]).where("y0 < w1 AND y1 > w0")
    return met.where(F.col("bin") == F.floor(F.greatest("y0", "w0") / size)).drop("bin")


def chunks(canvas: DataFrame, key: str, y: str, height: int, header: int = 0) -> DataFrame:
    """Adds chunk (index) and row_in_chunk: fixed-height slices, the last one shorter."""
    at = F.col(y) + header
    return canvas.withColumn("chunk", F.floor(at / height).cast("long")).withColumn("row_in_chunk", F.pmod(at, F.lit(height)).cast("long"))


def rescue_candidates(zones_df: DataFrame, frames: DataFrame, key: str, height: int, disc_y: int, disc_r: int, taken: DataFrame) -> DataFrame:
    """Zones (zone, y0, y1 inclusive) and frames (i, position) that cover them with the disc elsewhere, within the canvas
    (lo, hi of the key), and that aren't placed yet."""
    free = frames.join(taken.select(key, "i"), [key, "i"], "left_anti")
    met = overlapping(
        free.select(key, "i", F.col("position").alias("y0"), (F.col("position") + height).alias("y1"), "lo", "hi"),
        zones_df.select(key, "zone", F.col("y0").alias("w0"), (F.col("y1") + 1).alias("w1")),
        key,
    )
    covers = (F.col("y0") <= F.col("w0")) & (F.col("y1") >= F.col("w1"))
    top, bottom = F.col("y0") + disc_y - disc_r, F.col("y0") + disc_y + disc_r
    outside = (bottom < F.col("w0")) | (top >= F.col("w1"))
    return met.where(covers & outside & (F.col("y0") >= F.col("lo")) & (F.col("y1") <= F.col("hi")))
