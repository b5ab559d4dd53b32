"""Frames as rows: a Python data source over recordings on disk, and readers for the JSON and PNG artifacts.

A recording is a ``.npy`` array (frames, height, width[, 3]) of uint8; ``video_id`` is the file's name without its suffix.
Each recording is split into ranges of frames, one task each, and a range is read through a memory map, so crops and frame
numbers are applied before any pixel is copied.  The path must be reachable from all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

FRAME_SCHEMA = "video_id string, i long, h int, w int, pix_fmt string, data binary"
#: Frames of one task.
RANGE = 256

KEYFRAMES_SCHEMA = (
    "video struct<w:int,h:int,dyn_top:int,dyn_bot:int,dyn_h:int,frames_decoded:int,fps:double>, "
    "pauses array<struct<start:int,end:int,length:int,mid:int,drag_suspect:boolean>>, "
    "keyframes array<struct<i:int,pause_index:int,pause_length:int,drag_suspect:boolean>>, "
    "between_runs array<struct<from_pause:int,to_pause:int,gap_frames:int>>, dy_series array<int>, mad_series array<double>"
)


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class ScreenRecording(DataSource):
    """``spark.read.format("screenrec").option("path", folder)``; options crop (``top:bottom``), step (every nth frame)
    and pix_fmt (``rgb24`` or ``gray``) are applied where frames are read, and filters on ``i`` are pushed down."""

    @classmethod
    def name(cls) -> str:
        return "screenrec"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.top, self.bottom = (int(x) if x else None for x in options.get("crop", ":").split(":"))
        self.step, self.pix_fmt = int(options.get("step", 1)), options.get("pix_fmt", "rgb24")
        self.lo, self.hi, self.wanted = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("i",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            elif column == ("i",) and isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, f.value)
            elif column == ("i",) and isinstance(f, LessThanOrEqual):
                self.hi = f.value if self.hi is None else min(self.hi, f.value)
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        import glob
        import os

        import numpy as np

        out = []
        for path in sorted(glob.glob(os.path.join(self.path, "*.npy")) if os.path.isdir(self.path) else [self.path]):
            n = np.load(path, mmap_mode="r").shape[0]
            stop = n if self.hi is None else min(n, self.hi + 1)
            for lo in range(self.lo, stop, RANGE):
                hi = min(stop, lo + RANGE)
                if self.wanted is None or any(lo <= k < hi for k in self.wanted):
                    out.append(FrameRange(path, lo, hi))
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        import os

        import numpy as np

        frames = np.load(partition.path, mmap_mode="r")
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for i in range(partition.start, partition.stop):
            if i % self.step or self.wanted is not None and i not in self.wanted:
                continue
            x = np.asarray(frames[i, self.top : self.bottom])
            if self.pix_fmt == "gray" and x.ndim == 3:
                x = np.rint(x.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.uint8)
            yield name, i, x.shape[0], x.shape[1], "gray" if x.ndim == 2 else "rgb24", x.tobytes()


def read_frames(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ScreenRecording)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("screenrec").options(path=path, **options).load()


def videos(frames: DataFrame, fps: float = 60.0) -> DataFrame:
    """Per recording: w, h, nb_frames, fps, duration (0 if fps is 0)."""
    out = frames.groupBy("video_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.count(F.lit(1)).alias("nb_frames"))
    return out.withColumn("fps", F.lit(float(fps))).withColumn("duration", F.col("nb_frames") / fps if fps else F.lit(0.0))


def sample_frames(frames: DataFrame, n: int) -> DataFrame:
    """About ``n`` frames of each recording, evenly spaced."""
    count = frames.groupBy("video_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("_step"))
    return frames.join(count, "video_id").where("i % _step = 0 AND i div _step < " + str(int(n))).drop("_step")


def read_keyframes_json(spark: SparkSession, path: str) -> DataFrame:
    """The artifact of pause detection, one row a file."""
    return spark.read.schema(KEYFRAMES_SCHEMA).json(path, multiLine=True, allowNonNumericNumbers=True)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """PNG chunks in order of their names: path, data, h, y0 (running offset)."""
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    size = F.conv(F.hex(F.substring("content", 21, 4)), 16, 10).cast("long")  # the height in the header
    rows = files.select("path", F.col("content").alias("data"), size.alias("h"), F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    by = W.partitionBy("folder").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("y0", F.coalesce(F.sum("h").over(by), F.lit(0))).drop("folder")
