import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenreel.operators import reconcile, series
from lumenreel.streaming import placing


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_coalesce_agrees_with_a_greedy_merge(spark):
    rng, rows, wanted = np.random.default_rng(0), [], set()
    for video in range(30):
        dy, mad = rng.choice([0, 0, 0, 1, 2, 3], 60), rng.choice([0.0, 1.0, 3.0, 5.0], 60, p=[0.6, 0.2, 0.1, 0.1])
        rows += [(video, i, float(a), float(b)) for i, (a, b) in enumerate(zip(dy, mad, strict=True))]
        rest = [(i == 0) or (abs(dy[i]) <= 1 and mad[i] <= 2) for i in range(60)]
        runs, i = [], 0
        while i < 60:
            j = i
            while j < 60 and rest[j]:
                j += 1
            if j - i >= 3:
                runs.append([i, j])
            i = max(j, i + 1)
        merged = runs[:1]
        for s, e in runs[1:]:
            gap = range(merged[-1][1], s)
            if 1 <= len(gap) <= 2 and all(abs(dy[k]) <= 2 and mad[k] <= 4 for k in gap):
                merged[-1][1] = e
            else:
                merged.append([s, e])
        wanted |= {(video, s, e) for s, e in merged}
    df = frame(spark, rows, "v long, i long, dv double, mad double")
    got = series.coalesce_runs(series.pause_runs(df, "v"), df, "v")
    assert {(r.v, r.start, r.end) for r in got.collect()} == wanted


def test_empty_and_single_frame(spark):
    none = frame(spark, [], "v long, i long, dv double, mad double")
    assert series.pause_runs(none, "v").count() == 0
    one = frame(spark, [(1, 0, 0.0, 0.0)], "v long, i long, dv double, mad double")
    assert [(r.start, r.end) for r in series.pause_runs(one, "v", min_len=1).collect()] == [(0, 1)]


def test_bridges_replace_the_reference(spark):
    rows = [(1, i, float(y)) for i, y in enumerate([0, 30, 60, 95, 120, 180, 185])]
    got = series.bridge_frames(frame(spark, rows, "v long, i long, y double"), ["v"], "y", 100.0, 20.0).orderBy("i").collect()
    assert [(r.i, r.position, r.overlap) for r in got] == [(3, 95.0, 5.0), (5, 180.0, 15.0)]


def test_drag_series(spark):
    steps = [0, 10, 15, 5, -10, -15, -5, 0, 0, 0, 2]
    got = series.drag_series(frame(spark, [(1, i, float(s)) for i, s in enumerate(steps)], "v long, i long, dx double"), "v", "dx").orderBy("i").collect()
    assert [r.abs_dx for r in got] == [0, 10, 25, 30, 20, 5, 0, 0, 0, 0, 2]
    assert [r.is_drag for r in got] == [False, False, True, True, False, False, False, False, False, False, False]
    found = series.drag_sessions(frame(spark, [(1, i, float(v)) for i, v in enumerate([0, 25, 30, 30, 5, 40])], "v long, i long, x double"), "v", "x", 20)
    assert [(r.start_frame, r.end_frame, r.deepest_frame) for r in found.orderBy("index").collect()] == [(1, 3, 2), (5, 5, 5)]


FRAMES = [(0, 0), (1, 5), (2, 0), (3, 50), (4, -20), (5, -90), (6, 500)]


def _frames(spark):
    return frame(spark, [("v", i, dy, 0.1, 2.0) for i, dy in FRAMES], "video_id string, i long, dy int, sad double, conf double")


def test_placing_classes(spark):
    got = placing.place_batch(_frames(spark), "video_id", height=100).orderBy("i").collect()
    assert [(r.frame_class, r.y_top, r.new_rows) for r in got] == [("first", 0, 100), ("normal", 5, 5), ("stationary", 5, 0), ("normal", 55, 50), ("normal", 35, 0), ("normal", -55, 55), ("suspect", -55, 0)]
    assert [r.dy for r in got] == [0, 5, 0, 50, -20, -90, 0]  # what doesn't move the canvas has no motion
    rim = placing.place_batch(_frames(spark), "video_id", height=100, edge=60).orderBy("i").collect()
    assert [r.frame_class for r in rim] == ["first", "normal", "stationary", "normal", "edge_hit", "edge_hit", "edge_hit"]  # 50 was expected again


def test_stream_and_batch_agree(spark, tmp_path):
    source, rows = tmp_path / "in", _frames(spark).toPandas()
    source.mkdir()
    for k, part in enumerate((rows.iloc[:3], rows.iloc[3:])):
        part.to_parquet(source / f"{k}.parquet")
    stream = spark.readStream.schema(_frames(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = placing.place_stream(stream, "video_id", height=100).writeStream.format("memory").queryName("placed").outputMode("append").start()
    try:
        out.processAllAvailable()
        got = spark.table("placed").orderBy("i").toPandas()
    finally:
        out.stop()
    batch = placing.place_batch(_frames(spark), "video_id", height=100).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(got, batch)


def test_fuzzy_reconciliation(spark):
    a = frame(spark, [(1, 0, "alpha beta gamma delta"), (1, 1, "one two three"), (2, 0, "quite different words here"), (2, 1, "one two three")], "container long, line_no long, text string")
    b = frame(spark, [(9, 0, "alpha beta gamme delta"), (9, 1, "one two three"), (9, 2, "extra")], "container long, line_no long, text string")
    best = {r.text: (r.best, r.best_text) for r in reconcile.best_matches(a, b).collect()}
    assert best["one two three"] == (100, "one two three") and best["alpha beta gamma delta"][0] >= 85 and best["quite different words here"][0] < 85
    row = reconcile.report(a, b).first()
    assert (row.n_source, row.n_stitched, row.missing, row.unmatched) == (3, 3, 1, 1) and row.recall == pytest.approx(66.67)
    assert reconcile.duplicates(a, 8).collect()[0].n == 2
    assert reconcile.first_lines(a).where(F.col("text") == "one two three").first().container == 1


def test_best_matches_are_the_same_whichever_side_is_smaller(spark, monkeypatch):
    from lumenreel.functions.text import token_set_score

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "alphb"], int(rng.integers(1, 5)))) for _ in range(70)]
    few, many = sorted(set(texts[:12])), sorted(set(texts[12:]))
    lines = lambda some: frame(spark, [(1, k, t) for k, t in enumerate(some)], "container long, line_no long, text string")
    monkeypatch.setattr(reconcile, "QUERIES", 5)
    for a, b in ((many, few), (few, many)):
        best = {t: min((-token_set_score(t, o) if t != o else -101, len(o), o) for o in b) for t in a}
        got = {r.text: (r.best, r.best_text) for r in reconcile.best_matches(lines(a), lines(b)).collect()}
        assert got == {t: (min(100, -m[0]), m[2]) for t, m in best.items()}


def test_matched_lines_of_both_sides_are_those_of_brute_force(spark, monkeypatch):
    from lumenreel.functions.text import token_set_score

    rng = np.random.default_rng(8)
    words = ["a", "ab", "alpha", "alphb", "beta", "gamma", "gamna", "delta", "é", "日本", "日本語", "eps", "zeta" * 30, "zetb" * 30]
    few, many = ({" ".join(rng.choice(words, int(rng.integers(1, 6)))) for _ in range(n)} for n in (12, 90))
    lines = lambda some: frame(spark, [(1, k, t) for k, t in enumerate(sorted(some))], "container long, line_no long, text string")
    for queries in (5, 1_000):
        monkeypatch.setattr(reconcile, "QUERIES", queries)
        for a, b, limit in ((many, few, 85), (few, many, 60), (few, set(), 85)):
            hits = [(x, y) for x in a for y in b if token_set_score(x, y) >= limit]
            got = [(r.side, r.text) for r in reconcile.matched(lines(a), lines(b), limit).collect()]
            assert sorted(got) == sorted({(0, x) for x, _ in hits} | {(1, y) for _, y in hits})


def test_fuzzy_report_scores_no_pair_alone(spark, monkeypatch):
    # 400 by 40 lines of one alphabet were 32,000 calls of Python code, too slow for 0.1 GB
    rng = np.random.default_rng(2)
    line = lambda: " ".join("".join(rng.choice(list("etaoinshr"), 5)) for _ in range(20))
    some = [line() for _ in range(400)]
    frames = [frame(spark, [(1, k, t) for k, t in enumerate(x)], "container long, line_no long, text string") for x in (some, [line() for _ in range(39)] + [some[0] + " more"])]
    monkeypatch.setattr(reconcile, "score_bound", None)
    monkeypatch.setattr(reconcile, "token_set_score", None)
    row = reconcile.report(*frames).first()
    assert (row.n_source, row.n_stitched, row.missing, row.unmatched) == (400, 40, 399, 39)


def test_normalised_lines_of_odd_white_space(spark):
    import re

    texts = ["a b  c", " a ", "a \t b", "a\t b", "a\u00a0 b \u3000", "  ", "a \u2003", "\u001c a b\u0085c d", "x  y z   "]
    got = [r.text for r in reconcile.lines_of(frame(spark, [(1, "\n".join(texts))], "id long, text string"), "id", "text", 0).orderBy("line_no").collect()]
    assert got == [re.sub(r"[\s\u00a0]+", " ", t).strip() for t in texts]


def test_exact_quantile_narrows_to_the_same_value(spark):
    from lumenreel.operators import votes

    x = np.random.default_rng(3).standard_normal(4000).round(2)
    df = frame(spark, [(float(v),) for v in x] + [(None,)], "x double")
    for q in (0.0, 0.013, 0.5, 0.99, 1.0):
        for held in (100, 100_000):
            assert abs(spark.range(1).select(votes.exact_quantile(df, "x", q, held)).first()[0] - np.quantile(x, q)) < 1e-9
    assert spark.range(1).select(votes.exact_quantile(df.limit(0), "x", 0.5)).first()[0] is None


def test_previous_ids_across_ranges(spark):
    from lumenreel.operators import matching

    ids = [-7, 0, 3, 9, 10, 11, 40, 41, 100]
    got = matching.with_previous(frame(spark, [(k,) for k in ids], "id long"), "id", 10).orderBy("id").collect()
    assert [(r.id, r.prev) for r in got] == list(zip(ids[1:], ids, strict=False))
