"""Looking at frames and canvases: profiles, regions, brightness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import image
from lumenreel.operators.frames import band_of

CHANNELS = {"R": 0, "G": 1, "B": 2}


def pixels(frames: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """video_id, i, y, x, r, g, b, luma of a small region of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                band = band_of(row)
                band = band if band.ndim == 3 else np.repeat(band[:, :, None], 3, 2)
                part = band[y0:y1, x0:x1]
                y, x = np.indices(part.shape[:2])
                yield pd.DataFrame({"video_id": row.video_id, "i": row.i, "y": (y + y0).ravel(), "x": (x + x0).ravel(), "r": part[:, :, 0].ravel().astype(int), "g": part[:, :, 1].ravel().astype(int), "b": part[:, :, 2].ravel().astype(int), "luma": image.luma(part).ravel().astype(float)})

    return frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, i long, y long, x long, r int, g int, b int, luma double")


def edge_profile(region: DataFrame, axis: str = "row", channel: str = "luma") -> DataFrame:
    """Mean of a channel (R, G, B, luma) along each row or column of a region, and its step from the one before."""
    from pyspark.sql import Window as W

    at = "y" if axis == "row" else "x"
    out = region.groupBy("video_id", "i", at).agg(F.avg(channel.lower()).alias("mean"))
    return out.withColumn("step", F.col("mean") - F.lag("mean").over(W.partitionBy("video_id", "i").orderBy(at)))


def canvas_region(canvas: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """video_id, png of a region of the canvas, across chunks; black where nothing is."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((y1 - y0, x1 - x0, 3), np.uint8)
        for y, w, data in zip(group["canvas_y"], group["w"], group["rgba"], strict=True):
            row = np.frombuffer(data, np.uint8).reshape(w, 4)[max(0, x0) : x1, :3]
            out[y - y0, max(0, -x0) : max(0, -x0) + len(row)] = row
        return pd.DataFrame({"video_id": [group["video_id"].iloc[0]], "png": [image.png(out)]})

    return canvas.where(F.col("canvas_y").between(y0, y1 - 1)).groupBy("video_id").applyInPandas(run, "video_id string, png binary")


def overlays_of(frames: DataFrame, top: int, bottom: int) -> DataFrame:
    """Per frame the largest dark disc (x0, y0, x1, y1, null: none) and the scroll bar's columns (bar0, bar1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                band = band_of(row)
                found, bar = image.find_disc(band, top, bottom), image.find_scrollbar(band, top, bottom)
                out.append((row.video_id, row.i, *(found["bbox"] if found else [None] * 4), *(bar or (None, None))))
            frame = pd.DataFrame(out, columns=["video_id", "i", "x0", "y0", "x1", "y1", "bar0", "bar1"])
            yield frame.astype({c: "Int32" for c in frame.columns[2:]})

    return frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, i long, x0 int, y0 int, x1 int, y1 int, bar0 int, bar1 int")


def strided(rows: DataFrame, key: str, order: list[str], stride: int, n: int) -> DataFrame:
    """Every ``stride``-th row of a key, ``n`` at most."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("_n", at).where(f"_n % {stride} = 0 AND _n < {stride * n}").drop("_n")
