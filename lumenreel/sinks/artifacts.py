"""Artifacts: text reports, JSON reports, the pause timeline, the coverage bar, sidecar images, chunks with header and footer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import image

#: Colours of frame and support classes (fixed values).
CLASS_COLOURS = {"pause": (60, 160, 60), "drag": (200, 60, 60), "moving": (90, 90, 90)}
SUPPORT_COLOURS = {"gap": (220, 40, 40), "weak": (230, 180, 40), "ok": (60, 160, 60)}


def match_lines(matches: DataFrame, mine: str, theirs: str) -> DataFrame:
    """One line per text without a match: ``[score=%3d] MINE='..'  BEST_THEIRS='..'``, worst first."""
    text = F.format_string(f"[score=%3d] {mine}='%s'  BEST_{theirs}='%s'", "best", "text", F.coalesce("best_text", F.lit("")))
    return matches.orderBy("best", "text").select(text.alias("value"))


def duplicate_lines(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("n"), "text").select(F.format_string("x%2d: %s", "n", "text").alias("value"))


def token_lines(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("n"), "token").select(F.format_string("%3d  %s", "n", "token").alias("value"))


def over_repeated_lines(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("n_stitched"), "token").select(F.format_string("src=%3d stitch=%3d  %s", "n_source", "n_stitched", "token").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def report(key: str, **parts: DataFrame) -> DataFrame:
    """key, json: one document per recording, each part an array of that recording's rows."""
    out = None
    for name, df in parts.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        out = rows if out is None else out.join(rows, key, "full")
    return out.select(key, F.to_json(F.struct(*parts)).alias("json"))


def timeline(moves: DataFrame, pauses: DataFrame, keyframes: DataFrame, height: int = 60) -> DataFrame:
    """video_id, png: a column per frame; a stripe of its class above a bar whose heat is log(1 + abs(dy)), capped at the
    99th percentile; marks at keyframes and at every 100th frame."""
    inside = pauses.select("video_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), F.lit(True).alias("paused"))
    rows = moves.select("video_id", "i", "dy").join(inside, ["video_id", "i"], "left")
    rows = rows.join(keyframes.select("video_id", "i", F.lit(True).alias("key")), ["video_id", "i"], "left")
    rows = rows.join(moves.groupBy("video_id").agg(F.percentile(F.abs("dy"), 0.99).alias("cap")), "video_id")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        n = len(group)
        heat = np.clip(np.log1p(group["dy"].abs()) / max(1e-9, np.log1p(group["cap"].iloc[0])), 0, 1).to_numpy()
        out = np.zeros((height, n, 3), np.uint8)
        paused, keys = group["paused"].notna().to_numpy(), group["key"].notna().to_numpy()
        out[: height // 3] = np.where(paused[:, None], CLASS_COLOURS["pause"], CLASS_COLOURS["moving"])
        out[height // 3 :] = np.stack([255 * heat, 80 * (1 - heat), 160 * (1 - heat)], 1).astype(np.uint8)
        out[:, keys] = (255, 255, 255)
        out[-4:, (group["i"] % 100 == 0).to_numpy()] = (255, 255, 0)
        return pd.DataFrame({"video_id": [group["video_id"].iloc[0]], "png": [image.png(out)]})

    return rows.groupBy("video_id").applyInPandas(draw, "video_id string, png binary")


def coverage_bar(segments: DataFrame, key: str = "video_id", width: int = 24) -> DataFrame:
    """key, png: a row per canvas row in its support class's colour.  Drawn from segments, not from rows."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("y0")
        parts = []
        for a, b, cover in zip(group["y0"], group["y1"], group["cover"], strict=True):
            colour = SUPPORT_COLOURS["gap" if cover == 0 else "weak" if cover == 1 else "ok"]
            parts.append(np.broadcast_to(np.array(colour, np.uint8), (b - a, width, 3)))
        return pd.DataFrame({key: [group[key].iloc[0]], "png": [image.png(np.concatenate(parts))]})

    return segments.groupBy(key).applyInPandas(draw, f"{key} {dict(segments.dtypes)[key]}, png binary")


def frame_images(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """video_id, i, png of the wanted frames (keyframes, or the deepest frames of drags)."""
    from lumenreel.operators.frames import band_of


    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"video_id": pdf["video_id"], "i": pdf["i"], "png": [image.png(band_of(r)) for r in pdf.itertuples()]})

    rows = frames.join(wanted.select("video_id", "i").distinct(), ["video_id", "i"], "left_semi")
    return rows.select("video_id", "i", "h", "w", "pix_fmt", "data").mapInPandas(run, "video_id string, i long, png binary")


def with_header_and_footer(canvas: DataFrame, frames: DataFrame, top: int, bottom: int, mode: str = "keep-once") -> DataFrame:
    """Canvas rows with the static head of a recording's first frame before them and the static foot of its last frame after
    them (``keep-once``), or as they are (``strip``).  frames: full height."""
    from lumenreel.operators import compose

    if mode == "strip":
        return canvas
    if mode != "keep-once":
        raise ValueError(f"unknown mode {mode}")
    ends = canvas.groupBy("video_id").agg(F.min("canvas_y").alias("lo"), F.max("canvas_y").alias("hi"))
    last = frames.groupBy("video_id").agg(F.max("i").alias("i"))

    def lines(one: DataFrame) -> DataFrame:
        return compose.compose(compose.scanlines(one, one.select("video_id", "i", F.lit(0).cast("long").alias("abs_y")))).join(ends, "video_id")

    head = lines(frames.where("i = 0")).where(F.col("canvas_y") < top).withColumn("canvas_y", F.col("lo") - top + F.col("canvas_y"))
    foot = lines(frames.join(last, ["video_id", "i"], "left_semi")).where(F.col("canvas_y") >= bottom).withColumn("canvas_y", F.col("hi") + 1 + F.col("canvas_y") - bottom)
    return canvas.unionByName(head.select(*canvas.columns)).unionByName(foot.select(*canvas.columns))


def chunks_with_parts(chunks: DataFrame, top: bytes, bottom: bytes) -> DataFrame:
    """Every chunk with the same header and footer image (PNG bytes) above and below it."""

    def run(batches):
        head, foot = image.read_png(top), image.read_png(bottom)
        for pdf in batches:
            out = []
            for data in pdf["png"]:
                body = image.read_png(bytes(data))
                parts = [np.dstack([x, np.full(x.shape[:2], 255, np.uint8)]) if x.shape[2] == 3 and body.shape[2] == 4 else x for x in (head, foot)]
                out.append(np.concatenate([parts[0], body, parts[1]]))
            pdf["png"], pdf["height"] = [image.png(x) for x in out], [len(x) for x in out]
            yield pdf

    return chunks.mapInPandas(run, chunks.schema)


def recognised_lines(images: DataFrame, recognise) -> DataFrame:
    """video_id, i, line_no, text from images (video_id, i, png); ``recognise(bytes) -> list of lines`` is any engine that
    the executors have."""

    def run(batches):
        for pdf in batches:
            rows = [(v, i, k, t) for v, i, data in zip(pdf["video_id"], pdf["i"], pdf["png"], strict=True) for k, t in enumerate(recognise(bytes(data)))]
            yield pd.DataFrame(rows, columns=["video_id", "i", "line_no", "text"])

    return images.select("video_id", "i", "png").mapInPandas(run, "video_id string, i long, line_no long, text string")
