import pytest
from pyspark.sql import functions as F

from lumenreel.plans import guards


def test_recordings_without_frames_stop_the_run(spark):
    found = spark.createDataFrame([("a", 3)], "video_id string, nb_frames long")
    assert guards.checked_videos(found).first().nb_frames == 3
    with pytest.raises(Exception, match="recording b has no frames"):
        guards.checked_videos(found, spark.createDataFrame([("a",), ("b",)], "video_id string")).collect()
    with pytest.raises(Exception, match="recording c has no frames"):
        guards.checked_videos(spark.createDataFrame([("c", 0)], "video_id string, nb_frames long")).collect()
    assert guards.checked_videos(found.limit(0)).collect() == []


def test_bands_that_are_too_small_stop_the_run(spark):
    bands = spark.createDataFrame([("a", 10, 74)], "video_id string, top int, bottom int")
    assert tuple(guards.checked_bands(bands).first()) == ("a", 10, 74)
    with pytest.raises(Exception, match="from 10 to 74 is too small"):
        guards.checked_bands(bands, 65).collect()
    with pytest.raises(Exception, match="too small"):
        guards.checked_bands(bands.withColumn("bottom", F.lit(None).cast("int"))).collect()


def test_recordings_without_keyframes_stop_the_run(spark):
    keys = spark.createDataFrame([("a", 4), ("a", 9)], "video_id string, i long")
    assert sorted(map(tuple, guards.checked_keyframes(keys, keys).collect())) == [("a", 4), ("a", 9)]
    with pytest.raises(Exception, match="recording z has no keyframes"):
        guards.checked_keyframes(keys, spark.createDataFrame([("a",), ("z",)], "video_id string")).collect()


def test_frame_counts_that_differ_are_rows(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 1), ("c", 0)], "video_id string, i long")
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "video_id string, nb_frames long")
    assert sorted(map(tuple, guards.frame_counts(frames, expected).collect())) == [("a", 2, 2, False), ("b", 0, 1, True), ("c", 1, 0, True)]


def test_lists_are_cut_and_counts_are_not(spark):
    rows = spark.range(500).select(F.lit("a").alias("video_id"), F.col("id").alias("i"), (F.col("id") % 7).alias("conf"))
    got = guards.listed(rows, "video_id", "i").first()
    assert got.n == 500 and [p.i for p in got.pairs] == list(range(200)) and got.pairs[8].conf == 1
    assert guards.listed(rows.limit(0), "video_id", "i").collect() == []


def test_frame_labels(spark):
    rows = spark.createDataFrame([(1200, 60.0), (0, 60.0), (45, 30.0), (7, 0.0), (7, None), (90, 59.94)], "i long, fps double")
    got = [r.label for r in rows.select(guards.frame_label(F.col("i"), F.col("fps")).alias("label")).collect()]
    assert got == ["1200  (20.0s)", "0  (0.0s)", "45  (1.5s)", "7  (0.0s)", "7  (0.0s)", "90  (1.5s)"]
