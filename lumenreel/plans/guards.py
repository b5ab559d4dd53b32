"""Guards of a run: inputs that no plan can work with stop it, what is only doubtful becomes rows of a quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fail_if(wrong: Column, message: Column, value: Column) -> Column:
    """``value``, unless ``wrong`` holds (null: it does): then the task fails with ``message``."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(message)).otherwise(value)


def checked_videos(found: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``found`` (as :func:`sources.screenrec.videos` gives it); fails at a recording without frames.

    ``expected``: the recordings (video_id) that there must be; one that wasn't read at all counts as one without frames.
    """
    rows = found if expected is None else expected.select("video_id").distinct().join(found, "video_id", "left")
    message = F.format_string("recording %s has no frames", F.col("video_id").cast("string"))
    return rows.withColumn("nb_frames", _fail_if(F.col("nb_frames") <= 0, message, F.col("nb_frames")))


def checked_bands(bands: DataFrame, least: int = 64) -> DataFrame:
    """video_id, top, bottom; fails at a band that changes over fewer than ``least`` rows."""
    message = F.format_string("recording %s: band from %s to %s is too small", *[F.col(c).cast("string") for c in ("video_id", "top", "bottom")])
    return bands.withColumn("bottom", _fail_if(F.col("bottom") - F.col("top") < least, message, F.col("bottom")))


def checked_keyframes(keyframes: DataFrame, recordings: DataFrame) -> DataFrame:
    """``keyframes``; fails at a recording that has none."""
    message = F.format_string("recording %s has no keyframes", F.col("video_id").cast("string"))
    rows = recordings.select("video_id").distinct().join(keyframes, "video_id", "left")
    return rows.withColumn("i", _fail_if(F.col("i").isNull(), message, F.col("i"))).select(*keyframes.columns)


def frame_counts(frames: DataFrame, expected: DataFrame, key: str = "video_id") -> DataFrame:
    """key, frames_decoded, frames_expected (nb_frames of ``expected``), differs: recordings of either side."""
    read = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames_decoded"))
    both = read.join(expected.select(key, F.col("nb_frames").cast("long").alias("frames_expected")), key, "full")
    both = both.withColumn("frames_decoded", F.coalesce("frames_decoded", F.lit(0))).withColumn("frames_expected", F.coalesce("frames_expected", F.lit(0)))
    return both.select(key, "frames_decoded", "frames_expected", (F.col("frames_decoded") != F.col("frames_expected")).alias("differs"))


def listed(rows: DataFrame, key: str, order: str, limit: int = 200) -> DataFrame:
    """Per key: n, the number of all its rows, and pairs, the first ``limit`` of them in ``order`` as an array.

    The window needs no whole group in memory: only ``limit`` rows a key pass on, and n is a partial aggregate.
    """
    others = [c for c in rows.columns if c not in (key, order)]
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order, *others))).where(F.col("_k") <= limit)
    items = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("pairs"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(items, key)


def frame_label(frame: Column, fps: Column) -> Column:
    """``1200  (20.0s)``: a frame's number and time; 0.0 if the rate isn't known."""
    seconds = F.when(fps > 0, frame / fps).otherwise(F.lit(0.0))
    return F.format_string("%d  (%.1fs)", frame.cast("long"), F.bround(seconds, 1))
