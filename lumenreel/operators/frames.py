"""Operators whose rows carry pixels: signatures, motion from frames, static bands, overlay masks, extents, circles.

Pixels stay in binary columns and never enter a window; Spark bounds an Arrow batch by its bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default), so a batch holds few large frames or many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import image


def band_of(row) -> np.ndarray:
    shape = (row.h, row.w) if row.pix_fmt == "gray" else (row.h, row.w, 3)
    return np.frombuffer(row.data, np.uint8).reshape(shape)


def crop(frames: DataFrame, top: int, bottom: int) -> DataFrame:
    """Rows top to bottom of each frame, cut from the binary column without Python."""
    depth = F.when(F.col("pix_fmt") == "gray", 1).otherwise(3)
    data = F.substring(F.col("data"), F.lit(top) * F.col("w") * depth + 1, F.lit(bottom - top) * F.col("w") * depth)
    return frames.withColumn("data", data).withColumn("h", F.lit(bottom - top))


def signatures(frames: DataFrame, segments: int = 16, hpad: int = 40, vpad: int = 0) -> DataFrame:
    """video_id, i, rows (row signature, flattened), k (its width), cols (column signature)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                band = band_of(row)
                rows = image.row_profile(band, segments, hpad)
                out.append((row.video_id, row.i, rows.ravel(), rows.shape[1], image.col_profile(band, vpad)))
            yield pd.DataFrame(out, columns=["video_id", "i", "rows", "k", "cols"])

    return frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, i long, rows array<float>, k int, cols array<float>")


def motion(marks: DataFrame, radius: int = 400, min_overlap: int | None = None, alpha: float = 0.0, dx_radius: int = 0) -> DataFrame:
    """video_id, i, dy, mad, conf, overlap (and dx with ``dx_radius``): each frame against the one before.

    Neighbours meet by an equi-join on the frame number, so a recording's frames may be spread over all tasks.
    """
    before = marks.select("video_id", (F.col("i") + 1).alias("i"), F.col("rows").alias("ref_rows"), F.col("cols").alias("ref_cols"))
    pairs = marks.join(before, ["video_id", "i"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if row.ref_rows is None:
                    out.append((row.video_id, row.i, 0, 0.0, float("inf"), 0, 0))
                    continue
                cur, ref = np.array(row.rows).reshape(-1, row.k), np.array(row.ref_rows).reshape(-1, row.k)
                least = max(50, len(cur) // 8) if min_overlap is None else min_overlap
                p, sad, conf, overlap = image.match_1d(ref, cur, 0, radius, least, alpha)
                dx = image.match_1d(np.array(row.ref_cols), np.array(row.cols), 0, dx_radius, max(8, len(row.cols) // 6))[0] if dx_radius else 0
                out.append((row.video_id, row.i, p, sad, conf, overlap, dx))
            yield pd.DataFrame(out, columns=["video_id", "i", "dy", "mad", "conf", "overlap", "dx"])

    return pairs.mapInPandas(run, "video_id string, i long, dy int, mad double, conf double, overlap int, dx int")


def static_bands(frames: DataFrame, threshold: float = 12.0, min_run: int = 16, least: int = 32) -> DataFrame:
    """video_id, top, bottom: the widest stretch of rows whose mean brightness changes over the (sampled) frames.

    The whole frame if no stretch has ``min_run`` rows, if the widest has fewer than ``least``, or of a single frame.
    Each frame becomes a number a row; spreads follow from partial aggregation, so nothing is gathered per recording.
    """
    from lumenreel.operators.series import widest_run


    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                mean = image.luma(band_of(row)).mean(1).astype(np.float64)
                yield pd.DataFrame({"video_id": row.video_id, "y": np.arange(len(mean)), "v": mean})

    cells = frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, y long, v double")
    spread = cells.groupBy("video_id", "y").agg(F.stddev_pop("v").alias("s"))
    found = widest_run(spread, ["video_id"], F.col("s") > threshold, "y", max(min_run, least))
    whole = frames.groupBy("video_id").agg(F.max("h").alias("h"))
    out = whole.join(found.select("video_id", "start", "end"), "video_id", "left")
    return out.select("video_id", F.coalesce("start", F.lit(0)).cast("int").alias("top"), F.coalesce("end", "h").cast("int").alias("bottom"))


def overlay_masks(frames: DataFrame, share: float = 0.6, tolerance: float = 12, grow: int = 2, min_area: int = 30, rows: int = 32) -> DataFrame:
    """video_id, y, bits: the pixels of each row that stay the same while the content scrolls, one packed bit a pixel.

    Frames are cut into strips of ``rows`` rows; a strip's agreement needs only that strip of each (key)frame.  Dilation and
    the size of components need neighbours, so strips (a bit per pixel) meet again per recording for that.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                grey = image.luma(band_of(row), "mean").astype(np.float32)
                out += [(row.video_id, y // rows, row.w, grey[y : y + rows].tobytes()) for y in range(0, row.h, rows)]
            yield pd.DataFrame(out, columns=["video_id", "strip", "w", "data"])

    def agree(group: pd.DataFrame) -> pd.DataFrame:
        w = int(group["w"].iloc[0])
        stack = np.stack([np.frombuffer(d, np.float32).reshape(-1, w) for d in group["data"]])
        same = (np.abs(stack - np.median(stack, axis=0)) <= tolerance).mean(0) >= share if len(stack) >= 4 else np.zeros(stack.shape[1:], bool)
        return pd.DataFrame({"video_id": [group["video_id"].iloc[0]], "strip": [group["strip"].iloc[0]], "w": [w], "bits": [np.packbits(same).tobytes()], "n": [same.shape[0]]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("strip")
        w = int(group["w"].iloc[0])
        mask = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: n * w].reshape(n, w) for b, n in zip(group["bits"], group["n"], strict=True)]).astype(bool)
        mask = image.components(image.dilate(mask, grow), min_area)[0] > 0
        return pd.DataFrame({"video_id": group["video_id"].iloc[0], "y": np.arange(len(mask)), "w": w, "bits": [np.packbits(r).tobytes() for r in mask]})

    strips = frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(cut, "video_id string, strip int, w int, data binary")
    agreed = strips.groupBy("video_id", "strip").applyInPandas(agree, "video_id string, strip int, w int, bits binary, n int")
    return agreed.groupBy("video_id").applyInPandas(whole, "video_id string, y long, w int, bits binary")


def extents(frames: DataFrame, low: float = 40, high: float = 120, close: tuple[int, int] = (15, 3), pair_dx: int = 6) -> DataFrame:
    """video_id, i, y, r, l: the outermost edges of each row (null: none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                edges = image.close(image.canny(image.luma(band_of(row)), low, high), *close)
                r, left = image.row_extents(edges, pair_dx)
                nullable = lambda v: pd.array(np.where(v < 0, 0, v), dtype="Int32").copy()
                rs, ls = nullable(r), nullable(left)
                rs[r < 0], ls[left < 0] = pd.NA, pd.NA
                yield pd.DataFrame({"video_id": row.video_id, "i": row.i, "y": np.arange(row.h), "r": rs, "l": ls})

    return frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, i long, y long, r int, l int")


def circles(frames: DataFrame, r_min: int = 20, r_max: int = 100, votes: int = 30, min_dist: int = 60) -> DataFrame:
    """video_id, frame, hit (order of strength), cx, cy, r: the circles of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                found = image.circles(image.luma(band_of(row)).astype(np.uint8), r_min, r_max, min_dist, votes=votes)
                out += [(row.video_id, row.i, k, *c) for k, c in enumerate(found)]
            yield pd.DataFrame(out, columns=["video_id", "frame", "hit", "cx", "cy", "r"])

    return frames.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, frame long, hit int, cx int, cy int, r int")
