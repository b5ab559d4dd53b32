"""Compositing: scanlines of placed frames become canvas rows, canvas rows become chunks.

A placement (video_id, i, abs_y) turns the interval join of bands and canvas into an equi-join on the frame, after which
``canvas_y = abs_y + band_y``.  Scanlines are grouped into buckets of canvas rows; a bucket holds the few samples that cover
it, whatever the length of the recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import image
from lumenreel.operators.frames import band_of

#: Canvas rows of one group.
BUCKET = 64
CANVAS = "video_id string, canvas_y long, w int, rgba binary, clean_min int, samples int"


def scanlines(frames: DataFrame, placements: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """video_id, bucket, canvas_y, i, w, px (RGB bytes), dirty (packed bits of masked pixels, null: none).

    A placement whose frame isn't there is an error, since it would leave a hole.
    """
    missing = placements.select("video_id", "i").distinct().join(frames.select("video_id", "i"), ["video_id", "i"], "left_anti")
    first = [(r.video_id, r.i) for r in missing.orderBy("video_id", "i").limit(10).collect()]
    if first:
        raise RuntimeError(f"missing pixels of {missing.count()} placed frames: {first}")
    placed = frames.join(placements.select("video_id", "i", "abs_y"), ["video_id", "i"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                band = band_of(row)
                band = band if band.ndim == 3 else np.repeat(band[:, :, None], 3, axis=2)
                y = row.abs_y + np.arange(row.h)
                yield pd.DataFrame({"video_id": row.video_id, "bucket": y // BUCKET, "canvas_y": y, "band_y": np.arange(row.h), "i": row.i, "w": row.w, "px": [r.tobytes() for r in band]})

    lines = placed.select("video_id", "i", "abs_y", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, bucket long, canvas_y long, band_y long, i long, w int, px binary")
    if masks is None:
        return lines.withColumn("dirty", F.lit(None).cast("binary")).drop("band_y")
    marks = masks.select("video_id", F.col("y").alias("band_y"), F.col("bits").alias("dirty"))
    return lines.join(marks, ["video_id", "band_y"], "left").drop("band_y")


def compose(lines: DataFrame, policy: str = "median", tolerance: int = 16) -> DataFrame:
    """Canvas rows of :data:`CANVAS`: per pixel the truncated mean of the clean samples; where all samples are masked, by
    ``policy`` their truncated median (``median``), that only if two or more lie within the tolerance
    (``variance-gate``), or nothing (``hard-skip``).  Pixels without a colour are transparent."""
    if policy not in ("median", "variance-gate", "variance-gate-dilated", "hard-skip"):
        raise ValueError(f"unknown policy {policy}")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for y, rows in group.sort_values("i").groupby("canvas_y"):
            w = int(rows["w"].iloc[0])
            px = np.stack([np.frombuffer(p, np.uint8).reshape(w, 3) for p in rows["px"]]).astype(np.float32)
            clean = np.stack([np.ones(w, bool) if d is None else ~np.unpackbits(np.frombuffer(d, np.uint8))[:w].astype(bool) for d in rows["dirty"]])
            count = clean.sum(0)
            colour = (px * clean[:, :, None]).sum(0) / np.maximum(1, count)[:, None]
            known = count > 0
            if policy != "hard-skip":
                hole = ~known
                if policy.startswith("variance-gate"):
                    hole &= (np.ptp(px, axis=0).max(1) <= tolerance) & (len(px) >= 2)
                colour[hole] = np.median(px[:, hole], axis=0)
                known = known | hole
            rgba = np.concatenate([np.where(known[:, None], colour, 0).astype(np.uint8), np.where(known, 255, 0).astype(np.uint8)[:, None]], 1)
            out.append((rows["video_id"].iloc[0], y, w, rgba.tobytes(), int(count.min()), len(px)))
        return pd.DataFrame(out, columns=["video_id", "canvas_y", "w", "rgba", "clean_min", "samples"])

    return lines.groupBy("video_id", "bucket").applyInPandas(run, CANVAS)


def row_pass(canvas: DataFrame, what, extra: DataFrame | None = None) -> DataFrame:
    """Applies ``what(rgba row, record) -> rgba row`` to each canvas row; ``extra``: columns joined by video_id and canvas_y."""
    columns = canvas.columns
    joined = canvas if extra is None else canvas.join(extra, ["video_id", "canvas_y"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["rgba"] = [what(np.frombuffer(r.rgba, np.uint8).reshape(r.w, 4).copy(), r).tobytes() for r in pdf.itertuples()]
            yield pdf[columns]

    return joined.mapInPandas(run, canvas.schema)


def halo_pass(canvas: DataFrame, what, halo: int, rows: int = 256) -> DataFrame:
    """Applies ``what(rgba tile) -> rgba tile`` to tiles of ``rows`` canvas rows with ``halo`` rows of their neighbours on
    either side, which are dropped afterwards: for kernels that look a bounded distance up and down."""
    tile = F.floor(F.col("canvas_y") / rows).cast("long")
    reach = F.sequence(F.floor((F.col("canvas_y") - halo) / rows), F.floor((F.col("canvas_y") + halo) / rows))
    spread = canvas.withColumn("home", tile).withColumn("tile", F.explode(reach))
    columns = canvas.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("canvas_y")
        pixels = np.stack([np.frombuffer(p, np.uint8).reshape(w, 4) for p, w in zip(group["rgba"], group["w"], strict=True)])
        group["rgba"] = [r.tobytes() for r in what(pixels.copy())]
        return group[group["home"] == group["tile"]][columns]

    return spread.groupBy("video_id", "tile").applyInPandas(run, canvas.schema)


def fix_seams(canvas: DataFrame, same: int = 18, differs: int = 36, pad: int = 6, times: int = 2) -> DataFrame:
    return halo_pass(canvas, lambda x: image.fix_seams(x, same, differs, pad, times), times + 1)


def grow_holes(canvas: DataFrame, times: int = 2) -> DataFrame:
    """Isolated rejected pixels merge into whole holes."""
    return halo_pass(canvas, lambda x: image.grow_holes(x, times), times)


def fill_holes(canvas: DataFrame, radius: int = 3, halo: int = 32) -> DataFrame:
    """Transparent pixels take colours from what surrounds them: near ones by diffusion, the rest from the nearest pixel."""

    def run(x: np.ndarray) -> np.ndarray:
        hole = x[:, :, 3] == 0
        if hole.all() or not hole.any():
            return x
        x[:, :, :3] = image.diffuse_fill(x[:, :, :3], hole, radius)
        x[:, :, :3] = np.where(hole[:, :, None] & (x[:, :, :3].max(2, keepdims=True) == 0), image.nearest_fill(x[:, :, :3], hole), x[:, :, :3])
        x[:, :, 3] = 255
        return x

    return halo_pass(canvas, run, halo)


def fill_strips(canvas: DataFrame, strips: list[tuple[int, int]]) -> DataFrame:
    """Columns of persistent strips take the nearest good column's colour, row by row."""

    def run(row: np.ndarray, _) -> np.ndarray:
        bad = np.zeros((1, len(row)), bool)
        for a, b in strips:
            bad[0, a:b] = True
        return image.fill_rows(row[None], bad)[0]

    return row_pass(canvas, run)


def canvas_extents(found: DataFrame, placements: DataFrame, radius: int = 30) -> DataFrame:
    """Per canvas row the largest right extent, pooled over ``radius`` rows, and the smallest left one (rescued frames don't count)."""
    from lumenreel.operators.series import max_pool

    placed = placements.where("source != 'rescue'").select("video_id", "i", "abs_y")
    rows = found.join(placed, ["video_id", "i"]).withColumn("canvas_y", F.col("abs_y") + F.col("y"))
    rows = rows.groupBy("video_id", "canvas_y").agg(F.max("r").alias("r"), F.min("l").alias("l"))
    return max_pool(rows, "video_id", "canvas_y", "r", radius, "r_pooled")


def clear_beyond(canvas: DataFrame, reach: DataFrame, bg: tuple[int, int, int] = (0, 0, 0), inset: int = 1, pad: int = 0, rim: int = 16, soften: bool = True) -> DataFrame:
    """Pixels beyond a row's extents (:func:`canvas_extents`) become background, with a synthetic soft edge at the right."""

    def run(row: np.ndarray, r) -> np.ndarray:
        w = len(row)
        if r.r_pooled == r.r_pooled and r.r_pooled is not None:
            at = min(int(r.r_pooled), w - rim) + 1 + pad - inset
            row[max(0, at) :, :3] = bg
            if soften:
                row[None][:, :, :3] = image.soften_edge(row[None, :, :3], np.array([at]), bg)
        if r.l == r.l and r.l is not None:
            row[: max(0, int(r.l) - pad), :3] = bg
        return row

    return row_pass(canvas, run, reach.select("video_id", "canvas_y", "r_pooled", "l"))


def to_chunks(canvas: DataFrame, height: int = 4096, filler: tuple[int, int, int, int] = (255, 0, 0, 255)) -> DataFrame:
    """video_id, chunk, height, png: fixed-height slices; rows that nothing covers are filled with red.  A chunk fits a task."""
    rows = canvas.join(canvas.groupBy("video_id").agg(F.min("canvas_y").alias("y0")), "video_id").withColumn("y", F.col("canvas_y") - F.col("y0"))
    rows = rows.withColumn("chunk", F.floor(F.col("y") / height).cast("long"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at, w = (group["y"] % height).to_numpy(), int(group["w"].max())
        pixels = np.empty((int(at.max()) + 1, w, 4), np.uint8)
        pixels[:] = filler
        for y, p in zip(at, group["rgba"], strict=True):
            pixels[y] = np.frombuffer(p, np.uint8).reshape(w, 4)
        return pd.DataFrame({"video_id": [group["video_id"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "height": [len(pixels)], "png": [image.png(pixels)]})

    return rows.groupBy("video_id", "chunk").applyInPandas(run, "video_id string, chunk long, height int, png binary")


def write_chunks(chunks: DataFrame, write) -> None:
    """Hands each chunk's name and PNG bytes to ``write`` on the executors."""

    def each(rows) -> None:
        for r in rows:
            write(f"{r.video_id}/chunk_{r.chunk:04d}.png", r.png)

    chunks.foreachPartition(each)


def difference(a: DataFrame, b: DataFrame, gain: int = 4) -> DataFrame:
    """Two canvases row by row: video_id, canvas_y, diff (clipped, amplified absolute difference), mad; missing rows count as black."""
    x = a.select("video_id", "canvas_y", F.col("w").alias("aw"), F.col("rgba").alias("a"))
    y = b.select("video_id", "canvas_y", F.col("w").alias("bw"), F.col("rgba").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                p, q = (np.zeros(4, np.int16) if v is None else np.frombuffer(v, np.uint8).astype(np.int16) for v in (r.a, r.b))
                n = max(len(p), len(q))
                d = np.abs(np.pad(p, (0, n - len(p))) - np.pad(q, (0, n - len(q)))).reshape(-1, 4)[:, :3]
                out.append((r.video_id, r.canvas_y, np.clip(d * gain, 0, 255).astype(np.uint8).tobytes(), float(d.mean())))
            yield pd.DataFrame(out, columns=["video_id", "canvas_y", "diff", "mad"])

    return x.join(y, ["video_id", "canvas_y"], "full").mapInPandas(run, "video_id string, canvas_y long, diff binary, mad double")
