"""Registered queries of the operators whose rows carry pixels, with the SQL that must give the same pixels.

Each vector of ``embeddings`` stands for a frame of 8 x 8 pixels (a component's floor at 400 levels a unit, shifted by 128,
within a byte; no component: 128), ten ids in a row for a recording.  Vectors that haven't 64 components are no frames.
Colour frames have the byte, three and seven times it, modulo 256, as red, green and blue.  Frame i lies at canvas row 2 i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.catalog import query, read
from lumenreel.functions import image
from lumenreel.operators import compose
from lumenreel.operators import frames as fr

GREY = """fp AS (SELECT CAST(vec_id // 10 AS VARCHAR) AS video_id, vec_id % 10 AS i, k // 8 AS y, k % 8 AS x,
 CAST(greatest(0, least(255, floor(coalesce(CAST(embedding[k + 1] AS DOUBLE), 0) * 400) + 128)) AS BIGINT) AS v FROM embeddings, range(64) t(k) WHERE len(embedding) = 64)"""
COLOUR = f"{GREY}, fc AS (SELECT *, v AS r, v * 3 % 256 AS g, v * 7 % 256 AS b FROM fp)"
MASK = f"""{COLOUR}, md AS (SELECT video_id, y, x, median(v) AS md, count(*) AS n FROM fp GROUP BY ALL),
 ag AS (SELECT video_id, y, x, n >= 4 AND count(*) FILTER (WHERE abs(v - md) <= 18) * 10 >= n * 6 AS hit FROM fp JOIN md USING (video_id, y, x) GROUP BY video_id, y, x, n),
 di AS (SELECT DISTINCT a.video_id, a.y, a.x FROM ag a JOIN ag b ON a.video_id = b.video_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE b.hit),
 reach AS (SELECT video_id, y, x, y AS sy, x AS sx FROM di UNION SELECT d.video_id, d.y, d.x, r.sy, r.sx FROM reach r JOIN di d ON d.video_id = r.video_id AND abs(d.y - r.y) + abs(d.x - r.x) = 1),
 kept AS (SELECT video_id, sy AS y, sx AS x FROM reach GROUP BY ALL HAVING count(*) >= 12),
 mask AS (SELECT md.video_id, md.y, md.x, kept.x IS NOT NULL AS masked FROM md LEFT JOIN kept USING (video_id, y, x))"""
SAMPLES = f"""{MASK}, cp AS (SELECT video_id, i * 2 + y AS cy, x, count(*) AS n, count(*) FILTER (WHERE NOT masked) AS nc, count(*) >= 2 AND greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) <= 100 AS near,
 {", ".join(f"trunc(avg({c}) FILTER (WHERE NOT masked)) AS {c}c, trunc(median({c})) AS {c}m" for c in "rgb")} FROM fc JOIN mask USING (video_id, y, x) GROUP BY video_id, cy, x)"""


def _canvas_sql(gate: str) -> str:
    colours = ", ".join(f"CAST(CASE WHEN nc > 0 THEN {c}c WHEN {gate} THEN {c}m ELSE 0 END AS INTEGER) AS {c}" for c in "rgb")
    return f"{SAMPLES}, cv AS (SELECT video_id, cy, x, n, nc, CASE WHEN nc > 0 OR {gate} THEN 255 ELSE 0 END AS a, {colours} FROM cp)"


GATED, SKIPPED = _canvas_sql("near"), _canvas_sql("false")
RGBA = "string_agg(printf('%02X%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER), CAST(a AS INTEGER)), '' ORDER BY x) AS rgba"
SEAMS = f"""{GATED}, nb AS (SELECT *, {", ".join(f"lag({c}) OVER w AS {c}u, lead({c}) OVER w AS {c}d" for c in "rgb")} FROM cv WINDOW w AS (PARTITION BY video_id, x ORDER BY cy)),
 sm AS (SELECT *, coalesce(x BETWEEN 1 AND 6 AND greatest(abs(ru - rd), abs(gu - gd), abs(bu - bd)) <= 60 AND least(greatest(abs(r - ru), abs(g - gu), abs(b - bu)), greatest(abs(r - rd), abs(g - gd), abs(b - bd))) >= 20, false) AS bad
 FROM (SELECT *, ru IS NOT NULL AND rd IS NOT NULL AS inner_row FROM nb)),
 sx AS (SELECT video_id, cy, x, a, {", ".join(f"CASE WHEN bad AND inner_row THEN ({c}u + {c}d) // 2 ELSE {c} END AS {c}" for c in "rgb")} FROM sm)"""


def _frames(spark: SparkSession, sf_dir: str, colour: bool = False) -> DataFrame:
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.coalesce(x.cast("double"), F.lit(0.0)) * 400) + 128)).cast("long")
    two = lambda n: F.lpad(F.hex(n % 256), 2, "0")
    pixel = (lambda x: F.concat(two(byte(x)), two(byte(x) * 3), two(byte(x) * 7))) if colour else (lambda x: two(byte(x)))
    rows = read(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    video, data = F.floor(F.col("vec_id") / 10).cast("string"), F.unhex(F.concat_ws("", F.transform("embedding", pixel)))
    return rows.select(video.alias("video_id"), (F.col("vec_id") % 10).alias("i"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit("rgb24" if colour else "gray").alias("pix_fmt"), data.alias("data"))


def _placements(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "i", (F.col("i") * 2).alias("abs_y"), F.lit("keyframe").alias("source"))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.overlay_masks(_frames(spark, sf_dir), tolerance=18, grow=1, min_area=12, rows=4)


def _canvas(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    frames = _frames(spark, sf_dir, colour=True)
    return compose.compose(compose.scanlines(frames, _placements(frames), _masks(spark, sf_dir)), policy, tolerance=100)


def _seamless(canvas: DataFrame) -> DataFrame:
    return compose.halo_pass(canvas, lambda x: image.fix_seams(x, same=60, differs=20, pad=1, times=1), halo=2, rows=8)


def _shown(canvas: DataFrame) -> DataFrame:
    return canvas.select("video_id", "canvas_y", F.hex("rgba").alias("rgba"))


@query(f"WITH {COLOUR} SELECT video_id, i, string_agg(printf('%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)), '' ORDER BY y, x) AS data FROM fc WHERE y BETWEEN 2 AND 5 GROUP BY video_id, i")
def frame_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.crop(_frames(spark, sf_dir, colour=True), 2, 6).select("video_id", "i", F.hex("data").alias("data"))


@query(f"WITH {COLOUR} SELECT video_id, i, y, x // 2 AS stretch, CAST(sum(299 * r + 587 * g + 114 * b) AS BIGINT) AS total FROM fc GROUP BY ALL")
def frame_row_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of stretches of a row in BT.601 brightness, as thousandths summed over the stretch's two pixels."""
    marks = fr.signatures(_frames(spark, sf_dir, colour=True), 4, 0)
    cells = marks.select("video_id", "i", "k", F.posexplode("rows").alias("at", "v"))
    return cells.select("video_id", "i", F.expr("at div k").alias("y"), F.expr("CAST(at % k AS BIGINT)").alias("stretch"), F.round(F.col("v") * 2000).cast("long").alias("total"))


@query(f"WITH {COLOUR} SELECT video_id, i, x, CAST(sum(299 * r + 587 * g + 114 * b) AS BIGINT) AS total FROM fc WHERE y BETWEEN 2 AND 5 GROUP BY ALL")
def frame_column_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of columns without two rows at either end, as thousandths summed over the four rows."""
    marks = fr.signatures(_frames(spark, sf_dir, colour=True), 4, 0, vpad=2)
    return marks.select("video_id", "i", F.posexplode("cols").alias("at", "v")).select("video_id", "i", F.col("at").cast("long").alias("x"), F.round(F.col("v") * 4000).cast("long").alias("total"))


@query(f"""WITH {GREY}, m AS (SELECT video_id, i, y, x // 2 AS s, sum(v) AS v FROM fp GROUP BY ALL), o AS (SELECT unnest(range(-3, 4)) AS p),
 d AS (SELECT c.video_id, c.i, o.p, count(*) // 4 AS overlap, sum(abs(c.v - r.v)) AS total FROM o, m c JOIN m r ON r.video_id = c.video_id AND r.i = c.i - 1 AND r.s = c.s WHERE r.y = c.y + o.p GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY total / overlap, p) AS k FROM d)
SELECT f.video_id, f.i, CAST(coalesce(k.p, 0) AS INTEGER) AS dy, CAST(coalesce(k.overlap, 0) AS INTEGER) AS overlap, CAST(coalesce(k.total, 0) AS BIGINT) AS total
FROM (SELECT DISTINCT video_id, i FROM fp) f LEFT JOIN k ON k.video_id = f.video_id AND k.i = f.i AND k.k = 1""")
def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against the one before, matched by row signatures; total: the absolute difference over the shared rows."""
    found = fr.motion(fr.signatures(_frames(spark, sf_dir), 4, 0), radius=3, min_overlap=5)
    return found.select("video_id", "i", "dy", "overlap", F.round(F.col("mad") * F.col("overlap") * 8).cast("long").alias("total"))


@query(f"""WITH {GREY}, m AS (SELECT video_id, i, y, avg(v) AS v FROM fp GROUP BY ALL), s AS (SELECT video_id, y FROM m GROUP BY ALL HAVING stddev_pop(v) > 17),
 g AS (SELECT *, y - row_number() OVER (PARTITION BY video_id ORDER BY y) AS k FROM s), r AS (SELECT video_id, min(y) AS s, count(*) AS n FROM g GROUP BY video_id, k),
 w AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, s) AS k FROM r)
SELECT f.video_id, CAST(coalesce(w.s, 0) AS INTEGER) AS top, CAST(coalesce(w.s + w.n, 8) AS INTEGER) AS bottom FROM (SELECT DISTINCT video_id FROM fp) f LEFT JOIN w ON w.video_id = f.video_id AND w.k = 1 AND w.n >= 2""")
def frame_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.static_bands(_frames(spark, sf_dir), threshold=17, min_run=2, least=2)


@query(f"WITH RECURSIVE {MASK} SELECT video_id, y, printf('%02X', CAST(sum(CASE WHEN masked THEN 1 << (7 - x) ELSE 0 END) AS INTEGER)) AS bits FROM mask GROUP BY video_id, y")
def overlay_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistent pixels: agreement over the frames, dilation, components of 12 pixels or more."""
    return _masks(spark, sf_dir).select("video_id", "y", F.hex("bits").alias("bits"))


@query(f"WITH RECURSIVE {GATED} SELECT video_id, cy AS canvas_y, CAST(min(nc) AS INTEGER) AS clean_min, CAST(min(n) AS INTEGER) AS samples, {RGBA} FROM cv GROUP BY video_id, cy")
def canvas_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvas = _canvas(spark, sf_dir, "variance-gate")
    return canvas.select("video_id", "canvas_y", "clean_min", "samples", F.hex("rgba").alias("rgba"))


@query(f"WITH RECURSIVE {SEAMS} SELECT video_id, cy AS canvas_y, {RGBA} FROM sx GROUP BY video_id, cy")
def canvas_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from equal neighbours take their mean; tiles of eight rows, so that halos count."""
    return _shown(_seamless(_canvas(spark, sf_dir, "variance-gate")))


@query(f"""WITH RECURSIVE {SEAMS}, df AS (SELECT cv.video_id, cv.cy, cv.x, {", ".join(f"abs(cv.{c} - sx.{c}) AS {c}" for c in "rgb")} FROM cv JOIN sx USING (video_id, cy, x))
SELECT video_id, cy AS canvas_y, CAST(sum(r + g + b) AS BIGINT) AS total, string_agg(printf('%02X%02X%02X', {", ".join(f"CAST(least(255, 4 * {c}) AS INTEGER)" for c in "rgb")}), '' ORDER BY x) AS diff FROM df GROUP BY video_id, cy""")
def canvas_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canvas against itself after the seams are mended; total: the absolute difference over a row."""
    canvas = _canvas(spark, sf_dir, "variance-gate")
    found = compose.difference(canvas, _seamless(canvas))
    return found.select("video_id", "canvas_y", F.round(F.col("mad") * 24).cast("long").alias("total"), F.hex("diff").alias("diff"))


@query(f"""WITH RECURSIVE {SKIPPED}, gone AS (SELECT DISTINCT c.video_id, c.cy, c.x FROM cv c JOIN cv h ON h.video_id = c.video_id AND abs(h.cy - c.cy) + abs(h.x - c.x) <= 2 WHERE h.a = 0),
 gr AS (SELECT cv.video_id, cv.cy, cv.x, {", ".join(f"CASE WHEN gone.x IS NULL THEN cv.{c} ELSE 0 END AS {c}" for c in "rgba")} FROM cv LEFT JOIN gone USING (video_id, cy, x))
SELECT video_id, cy AS canvas_y, {RGBA} FROM gr GROUP BY video_id, cy""")
def canvas_holes_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(compose.grow_holes(_canvas(spark, sf_dir, "hard-skip")))


@query(f"""WITH RECURSIVE {GATED}, t AS (SELECT unnest([0, 1, 1, 4, 4, 5, 5, 7]) AS near, unnest(range(8)) AS x),
 st AS (SELECT cv.video_id, cv.cy, t.x, cv.r, cv.g, cv.b, cv.a FROM t JOIN cv ON cv.x = t.near) SELECT video_id, cy AS canvas_y, {RGBA} FROM st GROUP BY video_id, cy""")
def canvas_strips_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns 2, 3 and 6 take the nearest other column's colour, the left one of equals."""
    return _shown(compose.fill_strips(_canvas(spark, sf_dir, "variance-gate"), [(2, 4), (6, 7)]))


@query(f"""WITH {GREY}, e AS (SELECT video_id, i, y, max(x) FILTER (WHERE v > 170) AS r, min(x) FILTER (WHERE v > 170) AS l FROM fp GROUP BY ALL),
 c AS (SELECT video_id, 2 * i + y AS cy, max(r) AS r, min(l) AS l FROM e GROUP BY ALL)
SELECT video_id, cy AS canvas_y, CAST(r AS INTEGER) AS r, CAST(l AS INTEGER) AS l, CAST(max(r) OVER (PARTITION BY video_id ORDER BY cy ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS INTEGER) AS r_pooled FROM c""")
def canvas_row_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of bright pixels per frame row, per canvas row, pooled over two rows up and down."""
    frames = _frames(spark, sf_dir)
    cells = frames.select("video_id", "i", F.posexplode(F.sequence(F.lit(0), F.lit(63))).alias("at", "k"), "data")
    bright = F.conv(F.hex(F.substring("data", F.col("at") + 1, F.lit(1))), 16, 10).cast("int") > 170
    x = F.when(bright, F.col("at") % 8)
    found = cells.groupBy("video_id", "i", F.expr("at div 8").alias("y")).agg(F.max(x).alias("r"), F.min(x).alias("l"))
    return compose.canvas_extents(found, _placements(frames), radius=2).select("video_id", "canvas_y", "r", "l", "r_pooled")
