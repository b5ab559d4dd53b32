"""Operators over ordered frame series: consecutive motion, pauses, keyframes, positions, bridges, drags.

A series is keyed by ``key`` (one recording) and ordered by ``i``; windows are always partitioned by the key, and carry
numbers only, never pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_frames(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds ``i``, the frame's number in its recording, from 0."""
    return df.withColumn("i", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def motion(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``dv``, the change from the frame before, and ``mad``, its size; 0 for the first frame."""
    before = F.lag(value).over(W.partitionBy(key).orderBy("i"))
    dv = F.coalesce(F.col(value) - before, F.lit(0.0))
    return df.withColumn("dv", dv).withColumn("mad", F.abs(dv))


def stationary(dy: Column, mad: Column, dy_threshold: float = 1, mad_threshold: float = 2.0) -> Column:
    """Whether a frame rests; the first frame always does."""
    return F.when(F.col("i") == 0, True).otherwise((F.abs(dy) <= dy_threshold) & (mad <= mad_threshold))


def runs(df: DataFrame, key: Sequence[str], flag: Column, at: str = "i", min_len: int = 1) -> DataFrame:
    """Gaps and islands: per stretch of consecutive ``at`` where ``flag`` holds, start, end (exclusive) and length."""
    held = df.where(flag).withColumn("_g", F.col(at) - F.row_number().over(W.partitionBy(*key).orderBy(at)))
    out = held.groupBy(*key, "_g").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"), F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") >= min_len).drop("_g")


def pause_runs(df: DataFrame, key: str, dy: str = "dv", mad: str = "mad", dy_threshold: float = 1, mad_threshold: float = 2.0, min_len: int = 3) -> DataFrame:
    """Pauses: runs of resting frames of at least ``min_len``."""
    return runs(df, [key], stationary(F.col(dy), F.col(mad), dy_threshold, mad_threshold), min_len=min_len)


def coalesce_runs(pauses: DataFrame, series: DataFrame, key: str, dy: str = "dv", mad: str = "mad", dy_threshold: float = 2, mad_threshold: float = 4.0, max_gap: int = 2) -> DataFrame:
    """Merges neighbouring pauses if the one or two frames between them hardly move.

    Whether two neighbours merge depends on the raw runs alone, so it is a flag and a running sum.  The frames of a gap come
    from a join on frame numbers (a gap has at most ``max_gap``), not on a range.
    """
    by = W.partitionBy(key).orderBy("start")
    raw = pauses.select(key, "start", "end").withColumn("before", F.lag("end").over(by))
    gaps = raw.where((F.col("start") - F.col("before")).between(1, max_gap))
    gaps = gaps.select(key, "start", F.explode(F.sequence("before", F.col("start") - 1)).alias("i"))
    moving = series.where(~((F.abs(dy) <= dy_threshold) & (F.col(mad) <= mad_threshold))).select(key, "i")
    open_ = gaps.join(moving, [key, "i"], "left_anti").groupBy(key, "start").agg(F.count(F.lit(1)).alias("calm"))
    joined = raw.join(open_, [key, "start"], "left")
    new = F.when(F.col("calm") == F.col("start") - F.col("before"), 0).otherwise(1)
    joined = joined.withColumn("k", F.sum(new).over(by))
    out = joined.groupBy(key, "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(key, "start", "end", (F.col("end") - F.col("start")).alias("length"))


def keyframes(pauses: DataFrame, key: str) -> DataFrame:
    """One frame per pause, its middle: pause_index, i, pause_length."""
    at = F.row_number().over(W.partitionBy(key).orderBy("start")) - 1
    return pauses.select(key, at.cast("long").alias("pause_index"), F.expr("start + length div 2").alias("i"), F.col("length").alias("pause_length"))


def transitions(pauses: DataFrame, key: str) -> DataFrame:
    """Between consecutive pauses with frames between them: from_pause, to_pause, gap_frames."""
    by = W.partitionBy(key).orderBy("start")
    ranked = pauses.withColumn("from_pause", (F.row_number().over(by) - 1).cast("long")).withColumn("gap_frames", F.lead("start").over(by) - F.col("end"))
    return ranked.where("gap_frames > 0").select(key, "from_pause", (F.col("from_pause") + 1).alias("to_pause"), "gap_frames")


def positions(df: DataFrame, key: str, step: str) -> DataFrame:
    """Running position ``cum`` (0 at the first frame) and ``position``, moved so that the smallest is 0."""
    by = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("cum", F.sum(F.when(F.col("i") > 0, F.col(step)).otherwise(0)).over(by))
    return df.withColumn("position", F.col("cum") - F.min("cum").over(W.partitionBy(key)))


def chain_report(placed: DataFrame, key: str, order: str, position: str, height: float) -> DataFrame:
    """Step and overlap with the placement before, and whether a gap is left."""
    step = F.col(position) - F.lag(position).over(W.partitionBy(key).orderBy(order))
    return placed.withColumn("step", step).withColumn("overlap", F.greatest(F.lit(0), height - F.abs("step"))).withColumn("gap", F.abs("step") > height)


def bridge_frames(df: DataFrame, key: Sequence[str], position: str, height: float, margin: float) -> DataFrame:
    """Greedy cover of the way between two keyframes: a frame is placed as soon as it is ``height - margin`` away from the
    last one placed, which it then replaces.  ``df``: the frames of each gap (group), the first being the keyframe.

    The choice is sequential within a gap; gaps are independent.  overlap: what the placed frame really shares.
    """
    schema = ", ".join([*[f"{k} {dict(df.dtypes)[k]}" for k in key], "i long", "position double", "overlap double"])
    names, reach = list(key), height - margin

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        where, numbers = group[position].to_numpy(), group["i"].to_numpy()
        last, out = where[0], []
        for i, y in zip(numbers[1:], where[1:], strict=True):
            if abs(y - last) >= reach:
                out.append((int(i), float(y), float(max(0.0, height - abs(y - last)))))
                last = y
        found = pd.DataFrame(out, columns=["i", "position", "overlap"])
        for k in names:
            found[k] = group[k].iloc[0]
        return found[[*names, "i", "position", "overlap"]]

    return df.groupBy(*names).applyInPandas(choose, schema)


def drag_sessions(df: DataFrame, key: str, dx: str, threshold: float) -> DataFrame:
    """Stretches in which abs(dx) stays above the threshold: index, start_frame, end_frame (inclusive), deepest_frame, max_abs_dx.

    The deepest frame is the first with the largest displacement.
    """
    held = df.where(F.abs(dx) > threshold).withColumn("_g", F.col("i") - F.row_number().over(W.partitionBy(key).orderBy("i")))
    size = F.abs(F.col(dx))
    deepest = F.max_by("i", F.struct(size, -F.col("i")))
    out = held.groupBy(key, "_g").agg(F.min("i").alias("start_frame"), F.max("i").alias("end_frame"), deepest.alias("deepest_frame"), F.max(size).alias("max_abs_dx"))
    at = F.row_number().over(W.partitionBy(key).orderBy("start_frame")) - 1
    return out.drop("_g").withColumn("index", at.cast("long"))


def drag_series(df: DataFrame, key: str, dx: str, threshold: float = 20, reset_frames: int = 3) -> DataFrame:
    """Adds ``abs_dx`` and ``is_drag``: a running displacement that returns to 0 once ``reset_frames`` frames without motion
    follow each other while it is below the threshold.  Sequential within a recording; state is two numbers."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], "abs_dx double", "is_drag boolean"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i").reset_index(drop=True)
        total, still, seen = 0.0, 0, []
        for step in group[dx].fillna(0).to_numpy():
            total += step
            still = still + 1 if step == 0 else 0
            if still >= reset_frames and abs(total) < threshold:
                total = 0.0
            seen.append(total)
        group["abs_dx"] = seen
        group["is_drag"] = group["abs_dx"].abs() > threshold
        return group

    return df.groupBy(key).applyInPandas(walk, schema)


def widest_run(df: DataFrame, key: Sequence[str], flag: Column, at: str, least: int) -> DataFrame:
    """Per key the longest run of ``flag``, the first of equals, if it has ``least`` rows."""
    found = runs(df, key, flag, at)
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("length"), "start"))
    return found.withColumn("_r", first).where(f"_r = 1 AND length >= {least}").drop("_r")


def max_pool(df: DataFrame, key: str, order: str, value: str, radius: int, out: str = "pooled") -> DataFrame:
    """The largest value within ``radius`` rows on either side."""
    return df.withColumn(out, F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(-radius, radius)))


def dedup_blocks(df: DataFrame, key: str, start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Blocks in order of their start, each trimmed of the rows that earlier ones cover: from_y, rows; hole: rows left empty before."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("covered", F.max(end).over(by))
    begin = F.greatest(F.col(start), F.coalesce("covered", F.col(start)))
    df = df.withColumn("from_y", begin).withColumn("rows", F.greatest(F.lit(0), F.col(end) - F.col("from_y")))
    return df.withColumn("hole", F.greatest(F.lit(0), F.col(start) - F.coalesce("covered", F.col(start)))).drop("covered")
