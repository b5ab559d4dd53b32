"""From frames to keyframes: signatures, motion, pauses, keyframes, transitions, and the JSON artifact of a recording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.operators import frames as fr
from lumenreel.operators import series


@dataclass(frozen=True)
class Options:
    min_pause_len: int = 3
    dy_threshold: int = 1
    mad_threshold: float = 2.0
    search_radius: int = 400
    n_segments: int = 16
    hpad: int = 40
    drag_col_threshold: float = 4.0
    coalesce: bool = True
    min_overlap: int | None = None


def detect(frames: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """motion, pauses (with drag_suspect), keyframes, between_runs."""
    marks = fr.signatures(frames, options.n_segments, options.hpad)
    moves = fr.motion(marks, options.search_radius, options.min_overlap)
    pauses = series.pause_runs(moves, "video_id", "dy", "mad", options.dy_threshold, options.mad_threshold, options.min_pause_len)
    if options.coalesce:
        pauses = series.coalesce_runs(pauses, moves, "video_id", "dy", "mad")
    keys = series.keyframes(pauses, "video_id")
    # a pause whose column signature differs from the pause before's was dragged sideways
    cols = keys.join(marks.select("video_id", "i", "cols"), ["video_id", "i"])
    before = cols.select("video_id", (F.col("pause_index") + 1).alias("pause_index"), F.col("cols").alias("ref"))
    far = F.expr("aggregate(zip_with(cols, ref, (a, b) -> abs(cast(a AS double) - b)), 0D, (s, x) -> s + x) / size(cols)")
    drags = cols.join(before, ["video_id", "pause_index"]).where(far > options.drag_col_threshold).select("video_id", "pause_index", F.lit(True).alias("drag_suspect"))
    keys = keys.join(drags, ["video_id", "pause_index"], "left").withColumn("drag_suspect", F.coalesce("drag_suspect", F.lit(False)))
    return {"motion": moves, "pauses": pauses, "keyframes": keys, "between_runs": series.transitions(pauses, "video_id")}


def artifact(found: dict[str, DataFrame]) -> DataFrame:
    """video_id, json: keyframes, pauses, transitions, both series and a summary, as one document per recording."""
    listed = lambda df, name, *columns: df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    moves = found["motion"].groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("i", "dy", "mad"))).alias("m"))
    moves = moves.select("video_id", F.col("m.dy").alias("dy_series"), F.col("m.mad").alias("mad_series"), F.size("m").alias("n_frames"))
    out = moves.join(listed(found["pauses"], "pauses", "start", "end", "length"), "video_id", "left")
    out = out.join(listed(found["keyframes"], "keyframes", "i", "pause_index", "pause_length", "drag_suspect"), "video_id", "left")
    out = out.join(listed(found["between_runs"], "between_runs", "from_pause", "to_pause", "gap_frames"), "video_id", "left")
    summary = F.struct("n_frames", F.size("pauses").alias("pause_groups"), F.size("between_runs").alias("transitions"))
    return out.select("video_id", F.to_json(F.struct("pauses", "keyframes", "between_runs", "dy_series", "mad_series", summary.alias("summary"))).alias("json"))
