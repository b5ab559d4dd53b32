"""From motion and keyframes to a canvas: placements (keyframes, bridges, rescued frames), masks, compositing, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.operators import compose, coverage, series


def placements(moves: DataFrame, keyframes: DataFrame, height: int, margin: int = 120) -> DataFrame:
    """video_id, i, cum_y, abs_y, source, pause_index: keyframes, and bridges where two of them lie too far apart.

    A frame's position is the running sum of motion; only gaps whose net displacement leaves less than the margin get bridges.
    """
    where = series.positions(moves.select("video_id", "i", F.col("dy").cast("long").alias("dy")), "video_id", "dy").select("video_id", "i", F.col("cum").alias("cum_y"))
    keys = keyframes.join(where, ["video_id", "i"]).select("video_id", "i", "cum_y", "pause_index")
    by = W.partitionBy("video_id").orderBy("i")
    gaps = keys.withColumn("next_i", F.lead("i").over(by)).withColumn("next_y", F.lead("cum_y").over(by))
    wide = gaps.where(F.abs(F.col("next_y") - F.col("cum_y")) > height - margin)
    inside = wide.select("video_id", F.col("i").alias("gap"), F.explode(F.sequence("i", F.col("next_i") - 1)).alias("i"))
    inside = inside.join(where, ["video_id", "i"]).withColumn("y", F.col("cum_y").cast("double"))
    bridges = series.bridge_frames(inside.select("video_id", "gap", "i", "y"), ["video_id", "gap"], "y", float(height), float(margin))
    bridges = bridges.select("video_id", "i", F.col("position").cast("long").alias("cum_y"), F.lit(-1).cast("long").alias("pause_index"))
    both = keys.withColumn("source", F.lit("keyframe")).unionByName(bridges.withColumn("source", F.lit("bridge")))
    return both.withColumn("abs_y", F.col("cum_y") - F.min("cum_y").over(W.partitionBy("video_id")))


def rescue(placed: DataFrame, moves: DataFrame, height: int, disc_y: int, disc_r: int, most: int = 24) -> DataFrame:
    """More placements for zones that only one band covers where the disc lies: per zone the nearest free frame that shows it
    with the disc elsewhere; no frame twice, ``most`` per recording (the feature's own limit)."""
    import pandas as pd

    zone = F.row_number().over(W.partitionBy("video_id").orderBy("y0"))
    zones = coverage.zones(placed.select("video_id", F.col("abs_y").alias("y0"), (F.col("abs_y") + height).alias("y1")), "video_id", "y0", "y1", 1).withColumn("zone", zone)
    shift = placed.groupBy("video_id").agg(F.min("cum_y").alias("first"), F.min("abs_y").alias("lo"), (F.max("abs_y") + height).alias("hi"))
    where = series.positions(moves.select("video_id", "i", F.col("dy").cast("long").alias("dy")), "video_id", "dy").select("video_id", "i", "cum")
    free = where.join(shift, "video_id").withColumn("position", F.col("cum") - F.col("first"))
    found = coverage.rescue_candidates(zones, free, "video_id", height, disc_y, disc_r, placed)
    found = found.withColumn("far", F.abs(F.col("y0") + height / 2 - (F.col("w0") + F.col("w1")) / 2))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, options in group.sort_values(["zone", "far", "i"]).groupby("zone"):
            for row in options.itertuples():
                if row.i not in used and len(out) < most:
                    used.add(row.i)
                    out.append((row.video_id, row.i, row.y0, "rescue"))
                    break
        return pd.DataFrame(out, columns=["video_id", "i", "abs_y", "source"])

    return found.select("video_id", "zone", "i", "y0", "far").groupBy("video_id").applyInPandas(choose, "video_id string, i long, abs_y long, source string")


def stitch(frames: DataFrame, placed: DataFrame, masks: DataFrame | None = None, policy: str = "median", seams: bool = True) -> DataFrame:
    """Canvas rows of all placements."""
    canvas = compose.compose(compose.scanlines(frames, placed, masks), policy)
    canvas = compose.grow_holes(canvas) if policy == "variance-gate-dilated" else canvas
    return compose.fix_seams(canvas) if seams else canvas
