"""Checks and corrections of placements by matching signatures: the chain check and the refinement of rescued frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions.image import match_1d


def _match(pairs: DataFrame, radius: int, min_overlap: int, alpha: float) -> DataFrame:
    """Adds p, sad, overlap to pairs of signatures (rows, ref, k) with a prediction ``expected``."""
    columns = [c for c in pairs.columns if c not in ("rows", "ref", "k")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [match_1d(np.array(r.ref).reshape(-1, r.k), np.array(r.rows).reshape(-1, r.k), int(r.expected), radius, min_overlap, alpha) for r in pdf.itertuples()]
            out = pdf[columns].copy()
            out["p"], out["sad"], out["match_overlap"] = [f[0] for f in found], [f[1] for f in found], [f[3] for f in found]
            yield out

    schema = ", ".join([*[f"`{c}` {t}" for c, t in pairs.dtypes if c in columns], "p int, sad double, match_overlap int"])
    return pairs.mapInPandas(run, schema)


def chain_check(placed: DataFrame, marks: DataFrame, height: int, radius: int = 50, most: int = 20, min_overlap: int = 50) -> DataFrame:
    """Consecutive overlapping placements: the displacement of the chain (expected) and the direct one (p); off if they
    differ by more than ``most``."""
    by = W.partitionBy("video_id").orderBy("abs_y", "i")
    pairs = placed.select("video_id", "i", "abs_y", F.lead("i").over(by).alias("next_i"), (F.lead("abs_y").over(by) - F.col("abs_y")).alias("expected"))
    pairs = pairs.where((F.col("next_i").isNotNull()) & (F.abs("expected") < height))
    ref = marks.select("video_id", "i", F.col("rows").alias("ref"))
    cur = marks.select("video_id", F.col("i").alias("next_i"), "rows", "k")
    out = _match(pairs.join(ref, ["video_id", "i"]).join(cur, ["video_id", "next_i"]), radius, min_overlap, 0.0)
    return out.withColumn("off", F.abs(F.col("p") - F.col("expected")) > most)


def refine_rescued(placed: DataFrame, rescued: DataFrame, marks: DataFrame, height: int, radius: int = 80, alpha: float = 0.05) -> DataFrame:
    """Rescued placements moved to where they match their nearest placed frame; kept as they are if the match is poor (a
    correction of more than ``radius``, or an overlap of less than a quarter of the band or 96 rows)."""
    from lumenreel.operators.matching import nearest_anchor

    bias = F.when(F.col("source") == "keyframe", 0).otherwise(1) if "source" in placed.columns else F.lit(0)
    anchors = placed.select("video_id", "i", "abs_y", bias.alias("bias"))
    near = nearest_anchor(rescued.select("video_id", "i", "abs_y"), anchors, "video_id", "abs_y")
    pairs = rescued.select("video_id", "i", "abs_y").join(near.select("video_id", "i", "anchor"), ["video_id", "i"])
    pairs = pairs.join(placed.select("video_id", F.col("i").alias("anchor"), F.col("abs_y").alias("anchor_y")), ["video_id", "anchor"])
    pairs = pairs.withColumn("expected", F.col("abs_y") - F.col("anchor_y"))
    ref = marks.select("video_id", F.col("i").alias("anchor"), F.col("rows").alias("ref"))
    least = max(96, height // 4) if height >= 384 else max(16, height // 4)
    found = _match(pairs.join(ref, ["video_id", "anchor"]).join(marks.select("video_id", "i", "rows", "k"), ["video_id", "i"]), radius, least, alpha)
    good = (F.abs(F.col("p") - F.col("expected")) <= radius) & (F.col("match_overlap") >= least) & (F.col("sad") < float("inf"))
    return found.select("video_id", "i", F.when(good, F.col("anchor_y") + F.col("p")).otherwise(F.col("abs_y")).alias("abs_y"), (F.col("anchor_y") + F.col("p") - F.col("abs_y")).alias("correction"))
