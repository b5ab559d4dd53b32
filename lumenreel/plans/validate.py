"""Validation by invariants: neighbouring frames agree where they overlap, placed frames agree with the canvas, rows are covered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import image
from lumenreel.operators.frames import band_of


def pair_differences(frames: DataFrame, moves: DataFrame, warn: float = 1.0, least: int = 50) -> DataFrame:
    """video_id, i, dy, overlap, pair_mad, bad: each frame against the one before, moved by dy."""
    now = frames.join(moves.select("video_id", "i", "dy"), ["video_id", "i"])
    before = frames.select("video_id", (F.col("i") + 1).alias("i"), F.col("data").alias("ref"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                cur = band_of(row)
                ref = np.frombuffer(row.ref, np.uint8).reshape(cur.shape)
                mad, rows = image.overlap_mad(image.luma(ref), image.luma(cur), row.dy)
                out.append((row.video_id, row.i, row.dy, rows, mad if rows else None))
            yield pd.DataFrame(out, columns=["video_id", "i", "dy", "overlap", "pair_mad"])

    out = now.join(before, ["video_id", "i"]).select("video_id", "i", "h", "w", "pix_fmt", "data", "ref", "dy").mapInPandas(run, "video_id string, i long, dy int, overlap int, pair_mad double")
    return out.withColumn("bad", F.coalesce((F.col("pair_mad") > warn) & (F.col("overlap") >= least) & (F.col("dy") != 0), F.lit(False)))


def placement_differences(frames: DataFrame, placed: DataFrame, canvas: DataFrame, flagged: DataFrame, radius: int = 200, warn: float = 2.0) -> DataFrame:
    """For flagged frames only: how far the frame is from the canvas at its place and at the best place within ``radius``.

    Each flagged frame meets just the canvas rows that it may reach.
    """
    near = frames.join(flagged.select("video_id", "i"), ["video_id", "i"], "left_semi").join(placed.select("video_id", "i", "abs_y"), ["video_id", "i"])
    reach = near.select("video_id", "i", "abs_y", F.explode(F.sequence(F.col("abs_y") - radius, F.col("abs_y") + F.col("h") + radius - 1)).alias("canvas_y"))
    rows = reach.join(canvas.select("video_id", "canvas_y", "rgba"), ["video_id", "canvas_y"])
    tall = rows.groupBy("video_id", "i").agg(F.array_sort(F.collect_list(F.struct("canvas_y", "rgba"))).alias("rows"))  # one frame's reach

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                band = image.luma(band_of(row))
                held = {r["canvas_y"]: r["rgba"] for r in row.rows}
                y0 = min(held)
                part = np.full((max(held) - y0 + 1, row.w), -1000, np.float32)
                for y, p in held.items():
                    part[y - y0] = image.luma(np.frombuffer(p, np.uint8).reshape(-1, 4)[:, :3][None])[0]
                here = image.best_place(band, part, row.abs_y - y0, 0)[1]
                d, best = image.best_place(band, part, row.abs_y - y0, radius)
                out.append((row.video_id, row.i, row.abs_y, here if np.isfinite(here) else None, d, best if np.isfinite(best) else None))
            yield pd.DataFrame(out, columns=["video_id", "i", "abs_y", "canvas_mad", "best_dy_offset", "best_mad"])

    out = near.join(tall, ["video_id", "i"]).select("video_id", "i", "h", "w", "pix_fmt", "data", "abs_y", "rows").mapInPandas(run, "video_id string, i long, abs_y long, canvas_mad double, best_dy_offset int, best_mad double")
    wrong = F.col("canvas_mad").isNull() | (F.col("best_mad") + 0.5 < F.col("canvas_mad")) | (F.col("canvas_mad") > warn)
    return out.withColumn("bad", wrong)
