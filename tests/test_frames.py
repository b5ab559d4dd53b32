import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from scroll import FOOTER, HEADER, HEIGHT, WIDTH, page, recording

from lumenreel.functions import image
from lumenreel.operators import compose, coverage, votes
from lumenreel.operators import frames as fr
from lumenreel.plans import pause_detect, stitch, validate
from lumenreel.sources import screenrec

BAND = HEIGHT - HEADER - FOOTER
OPTIONS = pause_detect.Options(search_radius=12, n_segments=8, hpad=0, min_overlap=50)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("videos")
    for k in (1, 2):
        np.save(at / f"v{k}.npy", recording(k)[0])
    return str(at)


@pytest.fixture(scope="module")
def found(spark, folder):
    frames = screenrec.read_frames(spark, folder, crop=f"{HEADER}:{HEIGHT - FOOTER}")
    return frames, {k: v.cache() for k, v in pause_detect.detect(frames, OPTIONS).items()}


def test_source_pushes_frame_numbers_and_crops(spark, folder):
    frames = screenrec.read_frames(spark, folder, crop="16:20", pix_fmt="gray").where(F.col("i").isin(3, 7))
    rows = sorted((r.video_id, r.i, r.h, len(r.data)) for r in frames.collect())
    assert rows == [(v, i, 4, 4 * WIDTH) for v in ("v1", "v2") for i in (3, 7)]
    assert screenrec.read_frames(spark, folder, step="10").count() == 10
    info = {r.video_id: (r.w, r.h, r.nb_frames) for r in screenrec.videos(screenrec.read_frames(spark, folder)).collect()}
    assert info == {"v1": (WIDTH, HEIGHT, 41), "v2": (WIDTH, HEIGHT, 41)}
    assert screenrec.sample_frames(screenrec.read_frames(spark, folder), 4).count() == 8


def test_crop_of_rows_agrees_with_the_source(spark, folder):
    whole = fr.crop(screenrec.read_frames(spark, folder), 20, 30).where("i = 5")
    part = screenrec.read_frames(spark, folder, crop="20:30").where("i = 5")
    assert sorted(bytes(r.data) for r in whole.collect()) == sorted(bytes(r.data) for r in part.collect())


def test_static_bands(spark, folder):
    rows = fr.static_bands(screenrec.read_frames(spark, folder), threshold=4).collect()  # noise: the mean of a row hardly changes
    assert {(r.video_id, r.top, r.bottom) for r in rows} == {("v1", HEADER, HEIGHT - FOOTER), ("v2", HEADER, HEIGHT - FOOTER)}


def test_static_bands_fall_back_to_the_whole_frame(spark, folder):
    few = screenrec.read_frames(spark, folder).where("i = 0")
    assert {(r.top, r.bottom) for r in fr.static_bands(few).collect()} == {(0, HEIGHT)}
    low = fr.crop(screenrec.read_frames(spark, folder), HEADER - 4, HEADER + 20)
    assert {(r.top, r.bottom) for r in fr.static_bands(low, threshold=4).collect()} == {(0, 24)}


def test_frames_are_matched_against_the_growing_canvas(spark, folder, tmp_path):
    from lumenreel.streaming import placing

    marks = fr.signatures(fr.crop(screenrec.read_frames(spark, folder), HEADER, HEIGHT - FOOTER), 8, 4).cache()
    options = {"radius": 20, "first_radius": 40, "dx_radius": 10}
    got = placing.stitch_batch(marks, "video_id", BAND, **options).orderBy("video_id", "i").toPandas()
    steps = recording(1)[1]
    mine = got[got.video_id == "v1"]
    assert mine.dy.tolist() == steps.tolist() and mine.y_top.tolist() == np.cumsum(steps).tolist()
    assert set(mine.frame_class) == {"first", "normal", "stationary"} and mine.new_rows.sum() == BAND + np.cumsum(steps).max()
    rows, source = marks.toPandas(), tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((rows[rows.i < 9], rows[rows.i >= 9])):
        spark.createDataFrame(part, marks.schema).coalesce(1).write.mode("append").parquet(str(source / f"p{k}"))
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(str(source / "p*"))
    out = placing.stitch_stream(stream, "video_id", BAND, **options).writeStream.format("memory").queryName("stitched").outputMode("append").start()
    try:
        out.processAllAvailable()
        streamed = spark.table("stitched").orderBy("video_id", "i").toPandas()
    finally:
        out.stop()
    pd.testing.assert_frame_equal(streamed, got)


def test_motion_pauses_and_keyframes(found):
    steps = recording(1)[1]
    got = [r.dy for r in found[1]["motion"].where("video_id = 'v1'").orderBy("i").collect()]
    assert got == steps.tolist()
    pauses = [(r.start, r.end) for r in found[1]["pauses"].where("video_id = 'v1'").orderBy("start").collect()]
    assert pauses == [(0, 6), (18, 26), (36, 41)]
    assert [r.i for r in found[1]["keyframes"].where("video_id = 'v1'").orderBy("i").collect()] == [3, 22, 38]
    assert [r.gap_frames for r in found[1]["between_runs"].where("video_id = 'v1'").orderBy("from_pause").collect()] == [12, 10]
    doc = json.loads(pause_detect.artifact(found[1]).where("video_id = 'v1'").first().json)
    assert doc["summary"]["n_frames"] == 41 and len(doc["keyframes"]) == 3 and doc["dy_series"][7] == 5


def test_stitch_reproduces_the_page(spark, found, tmp_path):
    frames, parts = found
    placed = stitch.placements(parts["motion"], parts["keyframes"], BAND, margin=70).cache()
    assert placed.where("source = 'bridge'").count() > 0
    canvas = stitch.stitch(frames, placed).where("video_id = 'v1'").cache()
    rows = canvas.orderBy("canvas_y").collect()
    assert [r.canvas_y for r in rows] == list(range(len(rows)))
    pixels = np.stack([np.frombuffer(r.rgba, np.uint8).reshape(WIDTH, 4) for r in rows])
    assert (pixels[:, :, :3] == page(seed=1)[100 : 100 + len(rows)]).all() and (pixels[:, :, 3] == 255).all()
    chunks = compose.to_chunks(canvas, 64).orderBy("chunk").collect()
    assert [r.height for r in chunks][:-1] == [64] * (len(chunks) - 1)
    back = np.concatenate([image.read_png(bytes(r.png)) for r in chunks])
    assert (back == pixels).all()
    for r in chunks:
        (tmp_path / f"chunk_{r.chunk:04d}.png").write_bytes(r.png)
    read = screenrec.read_chunks(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.y0 for r in read] == [64 * k for k in range(len(read))]
    wrong = validate.pair_differences(frames, parts["motion"]).where("bad")
    assert wrong.count() == 0
    checked = validate.placement_differences(frames, placed, canvas, placed.where("video_id = 'v1'"), radius=5).collect()
    assert checked and all(not r.bad and r.canvas_mad == 0 for r in checked)
    assert compose.difference(canvas, canvas).agg(F.max("mad")).first()[0] == 0


def test_overlay_mask_and_masked_mean(spark, tmp_path):
    frames, _ = recording(3)
    mask = image.disc((HEIGHT, WIDTH), 60, 80, 9)
    frames = frames.copy()
    frames[:, mask] = 200
    np.save(tmp_path / "v.npy", frames)
    rows = screenrec.read_frames(spark, str(tmp_path), crop=f"{HEADER}:{HEIGHT - FOOTER}")
    keys = rows.where("i % 3 = 0")
    found = fr.overlay_masks(keys, grow=1, min_area=20).orderBy("y").collect()
    got = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8))[:WIDTH].astype(bool) for r in found])
    assert got[mask[HEADER : HEIGHT - FOOTER]].all()
    masks = fr.overlay_masks(keys, grow=1, min_area=20)
    moves = spark.createDataFrame([("v", i, int(d)) for i, d in enumerate(recording(3)[1])], "video_id string, i long, dy int")
    where = moves.toPandas()["dy"].cumsum()
    placed = spark.createDataFrame([("v", int(i), int(where[i] - where.min())) for i in range(0, 41, 3)], "video_id string, i long, abs_y long")
    canvas = compose.compose(compose.scanlines(rows, placed, masks), "variance-gate").orderBy("canvas_y").collect()
    pixels = np.stack([np.frombuffer(r.rgba, np.uint8).reshape(WIDTH, 4) for r in canvas])
    truth = page(seed=3)[100 + where.min() :][: len(pixels)]
    solid = pixels[:, :, 3] == 255
    clean = solid & ~np.all(pixels[:, :, :3] == 200, axis=2)
    assert (pixels[clean][:, :3] == truth[clean]).all() and clean.mean() > 0.9


def test_coverage_zones_and_rescue(spark):
    placed = spark.createDataFrame([("v", 0, 0, 0), ("v", 40, 80, 80)], "video_id string, i long, cum_y long, abs_y long")
    zones = coverage.zones(placed.withColumn("e", F.col("abs_y") + 100), "video_id", "abs_y", "e", 1).orderBy("y0").collect()
    assert [(z.y0, z.y1) for z in zones] == [(0, 79), (100, 179)]
    moves = spark.createDataFrame([("v", i, 2 if i else 0) for i in range(41)], "video_id string, i long, dy int")
    found = stitch.rescue(placed, moves, 100, disc_y=90, disc_r=5).collect()
    assert all(r.source == "rescue" and 0 <= r.abs_y <= 80 for r in found)


def test_persistent_circles(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = np.full((10, 90, 120), 20, np.uint8)
    for k in range(10):
        cx, cy = (60, 45) if k < 7 else (30, 50)
        frames[k][image.disc((90, 120), cx, cy, 18)] = 220
        frames[k] += rng.integers(0, 3, (90, 120), dtype=np.uint8)
    np.save(tmp_path / "c.npy", frames)
    hits = fr.circles(screenrec.read_frames(spark, str(tmp_path)), 14, 24, votes=20)
    best = votes.persistent(hits, "frame", "cx", "cy", "r", frames=10).collect()
    assert len(best) == 1 and abs(best[0].bx * 8 + 4 - 60) <= 6 and abs(best[0].r_median - 18) <= 2


def test_artifacts_and_inspection(spark, folder, found, tmp_path):
    from lumenreel.operators import inspect
    from lumenreel.plans import refine
    from lumenreel.sinks import artifacts, html_view

    frames, parts = found
    full = screenrec.read_frames(spark, folder)
    png = artifacts.timeline(parts["motion"], parts["pauses"], parts["keyframes"]).where("video_id = 'v1'").first().png
    assert image.read_png(bytes(png)).shape == (60, 41, 3)
    one = artifacts.frame_images(full, parts["keyframes"].where("video_id = 'v1' AND pause_index = 0")).collect()
    assert len(one) == 1 and (image.read_png(bytes(one[0].png)) == recording(1)[0][3]).all()
    placed = stitch.placements(parts["motion"], parts["keyframes"], BAND, margin=70).cache()
    canvas = stitch.stitch(frames, placed)
    whole = artifacts.with_header_and_footer(canvas, full, HEADER, HEIGHT - FOOTER)
    assert whole.where("video_id = 'v1'").count() == canvas.where("video_id = 'v1'").count() + HEADER + FOOTER
    region = inspect.canvas_region(canvas.where("video_id = 'v1'"), -2, 10, 5, 15).first()
    pixels = image.read_png(bytes(region.png))
    assert (pixels[:2] == 0).all() and (pixels[2:] == page(seed=1)[100:110, 5:15]).all()
    marks = fr.signatures(frames, 8, 0)
    assert refine.chain_check(placed, marks, BAND, radius=10).where("off").count() == 0
    away = placed.where("source = 'keyframe' AND pause_index = 1").select("video_id", "i", (F.col("abs_y") + 3).alias("abs_y"))
    back = refine.refine_rescued(placed.where("NOT (source = 'keyframe' AND pause_index = 1)"), away, marks, BAND, radius=10)
    assert {r.correction for r in back.collect()} == {-3}
    bar = artifacts.coverage_bar(coverage.segments(placed.withColumn("e", F.col("abs_y") + BAND), "video_id", "abs_y", "e"))
    assert bar.count() == 2
    profile = inspect.edge_profile(inspect.pixels(frames.where("i = 0"), 0, 4, 0, 5), "row", "R").where("video_id = 'v1'").orderBy("y").collect()
    assert [round(r["mean"], 3) for r in profile] == [round(float(x), 3) for x in page(seed=1)[100:105, 0:4, 0].mean(1)]
    doc = json.loads(artifacts.report("video_id", placements=placed, pauses=parts["pauses"]).where("video_id = 'v2'").first().json)
    assert {"placements", "pauses"} == set(doc)
    assert "a&amp;b.png" in html_view.page(["a&b.png"])
    lines = artifacts.recognised_lines(artifacts.frame_images(full, parts["keyframes"]), lambda data: ["first", "second"])
    assert lines.count() == 2 * parts["keyframes"].count()
    assert inspect.overlays_of(full.where("i < 2"), HEADER, HEIGHT - FOOTER).count() == 4


def test_a_placed_frame_that_was_not_read_is_an_error(spark):
    frames = spark.createDataFrame([("v", 0, 1, 1, "gray", b"x")], "video_id string, i long, h int, w int, pix_fmt string, data binary")
    placed = spark.createDataFrame([("v", i, 0) for i in (0, 7, 9)], "video_id string, i long, abs_y long")
    with pytest.raises(RuntimeError, match=r"2 placed frames: \[\('v', 7\), \('v', 9\)\]"):
        compose.scanlines(frames, placed)
    compose.scanlines(frames, placed.where("i = 0"))
