"""Every query over the reference operators, with the SQL that must give the same rows.

The tables stand for recordings: a user's events in order are a recording's frames (value: brightness or position),
embeddings in order are one-dimensional signatures, the lines of documents and of benchmark items are the two sides of a text
reconciliation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.operators import coverage, matching, reconcile, series, votes
from lumenreel.plans import guards

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FRAMES = "f AS (SELECT user_id, event_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
MOTION = f"{FRAMES}, m AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY i), 0.0) AS dv FROM f)"
REST = "(i = 0 OR abs(dv) <= 20)"
PAUSES = f"{MOTION}, g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM m WHERE {REST}), p AS (SELECT user_id, min(i) AS s, max(i) + 1 AS e, count(*) AS n FROM g GROUP BY user_id, k HAVING count(*) >= 3)"
POSITION = "trunc(dv)"
PLACED = f"{FRAMES}, pl AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS y0, CAST(floor(value) AS BIGINT) + 10 AS y1 FROM f)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    return series.index_frames(events, "user_id", ["ts", "event_id"])


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.motion(_frames(spark, sf_dir), "user_id", "value")


def _pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pause_runs(_motion(spark, sf_dir), "user_id", dy_threshold=20, mad_threshold=20)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.floor("value").cast("long")
    return read(spark, sf_dir, "events").select("user_id", "event_id", y.alias("y0"), (y + 10).alias("y1"))


# ------------------------------------------------------------------------------------------------- series


@query(f"WITH {MOTION} SELECT user_id, i, round(dv, 6) AS dv, round(abs(dv), 6) AS mad FROM m")
def motion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motion(spark, sf_dir).select("user_id", "i", F.round("dv", 6).alias("dv"), F.round("mad", 6).alias("mad"))


@query(f"WITH {MOTION} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE {REST}) AS stationary, round(min(dv), 6) AS dv_min, round(median(dv), 6) AS dv_median, round(avg(dv), 6) AS dv_mean, round(max(dv), 6) AS dv_max FROM m GROUP BY user_id")
def motion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = series.stationary(F.col("dv"), F.col("mad"), 20, 20)
    numbers = [F.round(f("dv"), 6).alias(f"dv_{name}") for name, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max))]
    return _motion(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(rest).alias("stationary"), *numbers)


@query(f'WITH {PAUSES} SELECT user_id, s AS "start", e AS "end", n AS length FROM p')
def pause_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pauses(spark, sf_dir)


COALESCED = f"""{PAUSES}, q AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS before FROM p),
 c AS (SELECT q.*, (SELECT count(*) FROM m WHERE m.user_id = q.user_id AND m.i >= q.before AND m.i < q.s AND abs(m.dv) <= 40) AS calm FROM q),
 r AS (SELECT *, sum(CASE WHEN s - before BETWEEN 1 AND 2 AND calm = s - before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s) AS k FROM c),
 co AS (SELECT user_id, min(s) AS s, max(e) AS e FROM r GROUP BY user_id, k)"""


@query(f'WITH {COALESCED} SELECT user_id, s AS "start", e AS "end", e - s AS length FROM co')
def pause_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.coalesce_runs(_pauses(spark, sf_dir), _motion(spark, sf_dir), "user_id", dy_threshold=40, mad_threshold=40)


@query(f"WITH {PAUSES} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS pause_index, s + n // 2 AS i, n AS pause_length FROM p")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.keyframes(_pauses(spark, sf_dir), "user_id")


@query(f"""WITH {PAUSES}, t AS (SELECT user_id, row_number() OVER w - 1 AS from_pause, lead(s) OVER w - e AS gap_frames FROM p WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, from_pause, from_pause + 1 AS to_pause, gap_frames FROM t WHERE gap_frames > 0""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.transitions(_pauses(spark, sf_dir), "user_id")


CUM = f"{MOTION}, c AS (SELECT *, sum(CASE WHEN i > 0 THEN CAST(trunc(dv) AS BIGINT) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS cum FROM m)"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _motion(spark, sf_dir).withColumn("step", F.col("dv").cast("long"))
    return series.positions(steps, "user_id", "step")


@query(f"WITH {CUM} SELECT user_id, i, CAST(cum AS BIGINT) AS cum, CAST(cum - min(cum) OVER (PARTITION BY user_id) AS BIGINT) AS position FROM c")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("user_id", "i", "cum", "position")


@query(f"""WITH {CUM}, s AS (SELECT user_id, i, CAST(cum - lag(cum) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS step FROM c)
SELECT user_id, i, step, CASE WHEN step IS NULL THEN 0.0 ELSE greatest(0.0, 100.0 - abs(step)) END::DOUBLE AS overlap, abs(step) > 100.0 AS gap FROM s""")
def chain_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.chain_report(_positions(spark, sf_dir).select("user_id", "i", "cum"), "user_id", "i", "cum", 100.0)
    return out.select("user_id", "i", "step", F.coalesce("overlap", F.lit(0.0)).cast("double").alias("overlap"), "gap")


@query(f"""WITH RECURSIVE {CUM}, b AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS last, 0::BIGINT AS placed FROM c WHERE i = 0
  UNION ALL
  SELECT b.user_id, c.i, CASE WHEN abs(c.cum - b.last) >= 180 THEN c.cum ELSE b.last END::BIGINT, CASE WHEN abs(c.cum - b.last) >= 180 THEN greatest(0, 200 - abs(c.cum - b.last)) + 1 ELSE 0 END::BIGINT
  FROM b JOIN c ON c.user_id = b.user_id AND c.i = b.i + 1)
SELECT user_id, i, last::DOUBLE AS position, (placed - 1)::DOUBLE AS overlap FROM b WHERE placed > 0""")
def bridge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bridge_frames(_positions(spark, sf_dir).select("user_id", "i", F.col("cum").cast("double").alias("cum")), ["user_id"], "cum", 200.0, 20.0)


DRAGS = f"{MOTION}, h AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM m WHERE abs(dv) > 60)"


@query(f"""WITH {DRAGS}, s AS (SELECT user_id, min(i) AS start_frame, max(i) AS end_frame, arg_max(i, struct_pack(a := abs(dv), b := -i)) AS deepest_frame, round(max(abs(dv)), 6) AS max_abs_dx FROM h GROUP BY user_id, k)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS "index" FROM s""")
def drag_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.drag_sessions(_motion(spark, sf_dir), "user_id", "dv", 60).withColumn("max_abs_dx", F.round("max_abs_dx", 6))


@query()
def drag_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.drag_series(_motion(spark, sf_dir).select("user_id", "i", "dv"), "user_id", "dv")
    return out.select("user_id", "i", F.round("abs_dx", 6).alias("abs_dx"), "is_drag")


@query("""WITH h AS (SELECT CAST(date_diff('hour', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS row_id, stddev_pop(value) > 12 AS dynamic FROM events GROUP BY 1),
 g AS (SELECT row_id, row_id - row_number() OVER (ORDER BY row_id) AS k FROM h WHERE dynamic), r AS (SELECT min(row_id) AS s, count(*) AS n FROM g GROUP BY k)
SELECT s AS "start", s + n AS "end", n AS length FROM r ORDER BY n DESC, s LIMIT 1""")
def static_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = read(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("row_id"), F.lit(0).alias("video")).agg(F.stddev_pop("value").alias("spread"))
    return series.widest_run(hours, ["video"], F.col("spread") > 12, "row_id", 1).select("start", "end", "length")


@query(f"WITH {FRAMES} SELECT user_id, i, round(max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 6) AS pooled FROM f")
def max_pool_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.max_pool(_frames(spark, sf_dir), "user_id", "i", "value", 30).select("user_id", "i", F.round("pooled", 6).alias("pooled"))


@query(f"""WITH {PLACED}, c AS (SELECT *, max(y1) OVER (PARTITION BY user_id ORDER BY y0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM pl)
SELECT user_id, event_id, greatest(y0, coalesce(covered, y0)) AS from_y, greatest(0, y1 - greatest(y0, coalesce(covered, y0))) AS rows, greatest(0, y0 - coalesce(covered, y0)) AS hole FROM c""")
def canvas_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dedup_blocks(_placed(spark, sf_dir), "user_id", "y0", "y1", ["y0", "event_id"]).select("user_id", "event_id", "from_y", "rows", "hole")


# ----------------------------------------------------------------------------------------------- coverage

ROWS = f"""{PLACED}, y AS (SELECT user_id, unnest(range(min(y0), max(y1))) AS y FROM pl GROUP BY user_id),
 cov AS (SELECT y.user_id, y.y, count(u.y) AS cover FROM y LEFT JOIN (SELECT user_id, unnest(range(y0, y1)) AS y FROM pl) u ON u.user_id = y.user_id AND u.y = y.y GROUP BY ALL)"""


@query(f"WITH {ROWS} SELECT user_id, y, cover FROM cov")
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rows(_placed(spark, sf_dir), "user_id", "y0", "y1")


@query(f"WITH {ROWS} SELECT user_id, CASE cover WHEN 0 THEN 'gap' WHEN 1 THEN 'weak' ELSE 'ok' END AS support, count(*) AS n_rows FROM cov GROUP BY ALL")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.classes(_placed(spark, sf_dir), "user_id", "y0", "y1")


@query(f"WITH {ROWS}, z AS (SELECT user_id, y, y - row_number() OVER (PARTITION BY user_id ORDER BY y) AS k FROM cov WHERE cover <= 1) SELECT user_id, min(y) AS y0, max(y) AS y1 FROM z GROUP BY user_id, k")
def starved_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.zones(_placed(spark, sf_dir), "user_id", "y0", "y1", 1)


@query(f"""WITH {PLACED}, ws AS (SELECT user_id, unnest(range(CAST(floor(min(y0) / 50) AS BIGINT) * 50, max(y1), 50)) AS w FROM pl GROUP BY user_id)
SELECT pl.user_id, event_id, w AS w0 FROM pl JOIN ws ON ws.user_id = pl.user_id AND y0 < w + 50 AND y1 > w""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    reach = placed.groupBy("user_id").agg((F.floor(F.min("y0") / 50) * 50).cast("long").alias("lo"), (F.max("y1") - 1).alias("hi"))
    windows = reach.select("user_id", F.explode(F.sequence("lo", "hi", F.lit(50).cast("long"))).alias("w0")).withColumn("w1", F.col("w0") + 50)
    return coverage.overlapping(placed, windows, "user_id").select("user_id", "event_id", "w0")


@query(f"""WITH {PLACED}, cv AS (SELECT user_id, event_id, y0 - min(y0) OVER (PARTITION BY user_id) AS y FROM pl)
SELECT user_id, event_id, y // 64 AS chunk, y % 64 AS row_in_chunk FROM cv""")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvas = _placed(spark, sf_dir).withColumn("y", F.col("y0") - F.min("y0").over(W.partitionBy("user_id")))
    return coverage.chunks(canvas, "user_id", "y", 64).select("user_id", "event_id", "chunk", "row_in_chunk")


# -------------------------------------------------------------------------------------- votes and pixels

PIXELS = "px AS (SELECT user_id % 10 AS x, CAST(floor(value / 8) AS BIGINT) AS y, value AS v, event_type = (SELECT min(event_type) FROM events) AS clean FROM events)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("t"))
    rows = events.join(F.broadcast(first), F.lit(True))  # one row
    return rows.select((F.col("user_id") % 10).alias("x"), votes.bin_of(F.col("value"), 8).alias("y"), F.col("value").alias("v"), (F.col("event_type") == F.col("t")).alias("clean"))


@query(f"WITH {PIXELS} SELECT x, y, CAST(trunc(avg(v) FILTER (WHERE clean)) AS INTEGER) AS mean, count(*) FILTER (WHERE clean) AS n_clean, count(*) AS n_all FROM px GROUP BY ALL")
def clean_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = votes.clean_mean(F.col("v"), F.col("clean")).alias("mean")
    return _pixels(spark, sf_dir).groupBy("x", "y").agg(mean, F.count_if("clean").alias("n_clean"), F.count(F.lit(1)).alias("n_all"))


@query(f"""WITH {PIXELS} SELECT x, y, CASE WHEN count(*) FILTER (WHERE clean) = 0 THEN CAST(trunc(median(v)) AS INTEGER) END AS median,
 CASE WHEN count(*) FILTER (WHERE clean) = 0 AND count(*) >= 2 AND max(v) - min(v) <= 4 THEN CAST(trunc(median(v)) AS INTEGER) END AS gated FROM px GROUP BY ALL""")
def gated_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, clean = F.col("v"), F.col("clean")
    return _pixels(spark, sf_dir).groupBy("x", "y").agg(votes.gated_median(v, clean).alias("median"), votes.gated_median(v, clean, 4).alias("gated"))


@query(f"""WITH {PIXELS}, a AS (SELECT x, y, median(v) AS md, count(*) AS n FROM px GROUP BY ALL HAVING count(*) >= 4)
SELECT x, y, round(any_value(md), 6) AS median, any_value(n) AS n, round(count(*) FILTER (WHERE abs(v - md) <= 1.5) / any_value(n), 6) AS agree, count(*) FILTER (WHERE abs(v - md) <= 1.5) / any_value(n) >= 0.6 AS masked
FROM px JOIN a USING (x, y) GROUP BY x, y""")
def agreement_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = votes.agreement(_pixels(spark, sf_dir), ["x", "y"], "v", tolerance=1.5)
    return out.select("x", "y", F.round("median", 6).alias("median"), "n", F.round("agree", 6).alias("agree"), "masked")


HITS = "hits AS (SELECT user_id AS frame, event_id AS hit, value AS cx, CAST(event_id % 40 AS DOUBLE) AS cy, CAST(20 + event_id % 7 AS INTEGER) AS r FROM events)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("frame"), hit.alias("hit"), F.col("value").alias("cx"), (hit % 40).cast("double").alias("cy"), (20 + hit % 7).cast("int").alias("r"))


@query(f"""WITH {HITS}, b AS (SELECT *, CAST(floor(cx / 8) AS BIGINT) AS bx, CAST(floor(cy / 8) AS BIGINT) AS "by" FROM hits), o AS (SELECT *, row_number() OVER (PARTITION BY frame, bx, "by" ORDER BY hit) AS k FROM b)
SELECT bx, "by", count(*) AS votes, median(r)::DOUBLE AS r_median, min(r) AS r_min, max(r) AS r_max FROM o WHERE k = 1 GROUP BY ALL HAVING count(*) >= 5""")
def bin_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.persistent(_hits(spark, sf_dir), "frame", "cx", "cy", "r", frames=10, prevalence=0.5)


BINS = f"{HITS}, b AS (SELECT CAST(floor(cx / 8) AS BIGINT) AS bx, CAST(floor(cy / 8) AS BIGINT) AS \"by\", CAST(floor(r / 8) AS BIGINT) AS br, r FROM hits)"


@query(f'WITH {BINS} SELECT bx, "by", br, count(*) AS n, min(r) AS r_min, max(r) AS r_max, round(avg(r), 1) AS r_mean FROM b GROUP BY GROUPING SETS ((bx, "by", br), (bx, "by"))')
def bin_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.census(_hits(spark, sf_dir), "cx", "cy", "r").withColumn("r_mean", F.round("r_mean", 1))


@query(f'WITH {BINS} SELECT bx, "by", count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, bx, "by" LIMIT 20')
def top_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return votes.top_values(hits.select(votes.bin_of(F.col("cx"), 8).alias("bx"), votes.bin_of(F.col("cy"), 8).alias("by")), ["bx", "by"], 20)


COLOURS = "px AS (SELECT l_shipdate AS place, (ascii(l_returnflag) << 16) | (ascii(l_linestatus) << 8) | l_linenumber AS c FROM lineitem)"


@query(f"WITH {COLOURS}, k AS (SELECT place, c, count(*) AS n, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, c) AS r FROM px GROUP BY place, c) SELECT place, CAST(c AS BIGINT) AS colour, CAST((c >> 16) & 255 AS INTEGER) AS r, CAST((c >> 8) & 255 AS INTEGER) AS g, CAST(c & 255 AS INTEGER) AS b FROM k WHERE r = 1")
def mode_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = votes.packed(F.ascii("l_returnflag"), F.ascii("l_linestatus"), F.col("l_linenumber"))
    out = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("place"), colour.alias("c")).groupBy("place").agg(votes.mode_of(F.col("c")).alias("colour"))
    return out.select("place", "colour", votes.unpacked(F.col("colour")).alias("p")).select("place", "colour", "p.*")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 3")
def top_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.top_values(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], 3)


@query("""WITH h AS (SELECT CAST(floor(greatest(abs(l_quantity - 25), abs(l_discount * 100 - 5), abs(l_tax * 100 - 4)) / 8) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1)
SELECT bucket, n, round(100 * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS cum_pct FROM h""")
def brightness_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.greatest(F.abs(F.col("l_quantity") - 25), F.abs(F.col("l_discount") * 100 - 5), F.abs(F.col("l_tax") * 100 - 4))
    return votes.distance_histogram(read(spark, sf_dir, "lineitem"), far, 8)


@query(f"WITH {MOTION} SELECT round(quantile_cont(abs(dv), 0.99), 6) AS cap, round(ln(1 + quantile_cont(abs(dv), 0.99)), 6) AS log_cap FROM m")
def heat_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = votes.exact_quantile(_motion(spark, sf_dir), "mad", 0.99)
    return spark.range(1).select(F.round(cap, 6).alias("cap"), F.round(F.log1p(cap), 6).alias("log_cap"))


@query("""WITH f AS (SELECT event_id AS i, user_id, CAST(20 + value AS DOUBLE) AS luma FROM events), d AS (SELECT user_id, i, luma FROM f WHERE luma > 30 AND luma < 120)
SELECT user_id, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM d GROUP BY user_id HAVING count(*) >= 5""")
def dark_disc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = (20 + F.col("value")).cast("double")
    dark = read(spark, sf_dir, "events").select("event_id", "user_id", luma.alias("luma")).where("luma > 30 AND luma < 120")
    return dark.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_i"), F.max("event_id").alias("last_i")).where("n >= 5")


# ------------------------------------------------------------------------------------------------ matching

PAIRS = "e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS cur, [CAST(x AS DOUBLE) FOR x IN lag(embedding) OVER (ORDER BY vec_id)] AS ref FROM embeddings)"
SCORES = f"""{PAIRS}, o AS (SELECT vec_id, cur, ref, unnest(range(-8, 9)) AS p FROM e WHERE ref IS NOT NULL),
 s AS (SELECT vec_id, p, 64 - abs(p) AS overlap, list_sum([abs(cur[i + 1] - ref[i + p + 1]) FOR i IN range(greatest(0, -p), least(64, 64 - p))]) / (64 - abs(p)) AS sad FROM o)"""


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sad, 12), p) AS k FROM s) SELECT vec_id, CAST(p AS INTEGER) AS p, round(sad, 6) AS sad, CAST(overlap AS INTEGER) AS overlap FROM r WHERE k = 1")
def offset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.offset_scores(_signature_pairs(spark, sf_dir), 8, 32).transform(matching.best_offsets).select("vec_id", "p", F.round("sad", 6).alias("sad"), "overlap")


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sad, 12), p) AS k FROM s), b AS (SELECT vec_id, p, sad FROM r WHERE k = 1)
SELECT b.vec_id, round(min(s.sad) / any_value(b.sad), 6) AS confidence FROM b JOIN s ON s.vec_id = b.vec_id AND abs(s.p - b.p) > 3 GROUP BY b.vec_id""")
def offset_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = matching.offset_scores(_signature_pairs(spark, sf_dir), 8, 32)
    return matching.confidence(scores).select("vec_id", F.round("confidence", 6).alias("confidence"))


def _signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("cur"))
    # consecutive signatures meet by an equi-join on the number before; the array doesn't go through a window
    numbered = matching.with_previous(rows.select("vec_id"), "vec_id")
    ref = rows.select(F.col("vec_id").alias("prev"), F.col("cur").alias("ref"))
    return numbered.join(rows, "vec_id").join(ref, "prev").select("vec_id", "cur", "ref")


@query(f"""WITH {CUM}, k AS (SELECT user_id, i, cum, CASE WHEN abs(dv) <= 5 THEN 0 ELSE 5 END AS bias FROM c WHERE {REST}),
 d AS (SELECT c.user_id, c.i, k.i AS anchor, abs(c.cum - k.cum) + k.bias AS far FROM c JOIN k USING (user_id) WHERE NOT (c.i = 0 OR abs(c.dv) <= 20))
SELECT user_id, i, anchor, CAST(far AS BIGINT) AS far FROM (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY far, anchor) AS r FROM d) WHERE r = 1""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame that moves, and the resting one nearest to it; frames that rest less well have a bias."""
    frames = _positions(spark, sf_dir).select("user_id", "i", "cum", "mad", series.stationary(F.col("dv"), F.col("mad"), 20, 20).alias("rests"))
    bias = F.when(F.col("mad") <= 5, 0).otherwise(5)
    return matching.nearest_anchor(frames.where("NOT rests"), frames.where("rests").withColumn("bias", bias), "user_id", "cum")


@query()
def nearest_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame that isn't placed itself, and the placed one nearest to it: a keyframe, or a bridge with a bias of 1."""
    frames = _positions(spark, sf_dir).select("user_id", "i", "cum")
    placed = keyframes(spark, sf_dir).select("user_id", "i", F.lit(0).alias("bias")).unionByName(bridge_points(spark, sf_dir).select("user_id", "i", F.lit(1).alias("bias")))
    placed = placed.groupBy("user_id", "i").agg(F.min("bias").alias("bias"))
    return matching.nearest_anchor(frames.join(placed, ["user_id", "i"], "left_anti"), frames.join(placed, ["user_id", "i"]), "user_id", "cum")


@query(f"""WITH {MOTION}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM m WHERE abs(dv) > 20 AND i > 0)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE r <= 5) AS listed, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE r <= 5) AS frames FROM b GROUP BY user_id""")
def low_confidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's cut list of doubtful frames beside the number of all of them."""
    doubtful = _motion(spark, sf_dir).where("mad > 20 AND i > 0").select("user_id", "i")
    out = guards.listed(doubtful, "user_id", "i", 5)
    return out.select("user_id", "n", F.size("pairs").cast("long").alias("listed"), F.concat_ws(",", F.expr("transform(pairs, p -> cast(p.i AS string))")).alias("frames"))


@query("""WITH d AS (SELECT user_id, count(*) AS frames_decoded FROM events GROUP BY user_id), e AS (SELECT o_custkey AS user_id, count(*) AS frames_expected FROM orders GROUP BY o_custkey)
SELECT user_id, coalesce(frames_decoded, 0) AS frames_decoded, coalesce(frames_expected, 0) AS frames_expected, coalesce(frames_decoded, 0) <> coalesce(frames_expected, 0) AS differs FROM d FULL JOIN e USING (user_id)""")
def frame_count_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read against frames announced; orders of a customer stand for what a user's recording announces."""
    expected = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("nb_frames"))
    return guards.frame_counts(read(spark, sf_dir, "events"), expected, "user_id")


@query(f"""WITH {MOTION}, w AS (SELECT *, row_number() OVER (ORDER BY abs(dv) DESC, user_id, i) AS r FROM m WHERE abs(dv) > 60 AND NOT {REST}) SELECT user_id, i, round(abs(dv), 6) AS mad FROM w WHERE r <= 10""")
def worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _motion(spark, sf_dir).where(F.col("mad") > 60)
    return bad.orderBy(F.desc("mad"), "user_id", "i").limit(10).select("user_id", "i", F.round("mad", 6).alias("mad"))


@query(f"""WITH {MOTION}, flagged AS (SELECT user_id, i FROM m WHERE abs(dv) > 60), near AS (SELECT g.user_id, g.i, min(abs(b.value - a.value)) AS best FROM flagged g JOIN f a ON a.user_id = g.user_id AND a.i = g.i
 JOIN f b ON b.user_id = g.user_id AND b.i BETWEEN g.i - 3 AND g.i + 3 AND b.i <> g.i GROUP BY g.user_id, g.i) SELECT user_id, i, round(best, 6) AS best FROM near""")
def two_phase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _motion(spark, sf_dir)
    flagged = frames.where(F.col("mad") > 60).select("user_id", "i", "value")
    around = flagged.select("user_id", "i", "value", F.explode(F.sequence(F.col("i") - 3, F.col("i") + 3)).alias("j")).where("j != i")
    other = frames.select("user_id", F.col("i").alias("j"), F.col("value").alias("there"))
    return around.join(other, ["user_id", "j"]).groupBy("user_id", "i").agg(F.round(F.min(F.abs(F.col("there") - F.col("value"))), 6).alias("best"))


# ------------------------------------------------------------------------------------------------ the text side

NORMAL = "trim(regexp_replace({}, '[\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
LINES = f"""l AS (SELECT doc_id AS container, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
 ln AS (SELECT container, line_no, {NORMAL.format('raw')} AS text FROM l WHERE length({NORMAL.format('raw')}) >= 3)"""
OTHER = f"""b AS (SELECT item_id AS container, unnest(string_split(text, chr(10))) AS raw FROM benchmark), bl AS (SELECT container, {NORMAL.format('raw')} AS text FROM b WHERE length({NORMAL.format('raw')}) >= 3)"""


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.lines_of(read(spark, sf_dir, "documents"), "doc_id", "text")


def _item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.lines_of(read(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"WITH {LINES} SELECT container, line_no, md5(text) AS digest FROM ln")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("container", "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY container, line_no) AS k, count(*) OVER (PARTITION BY text) AS occurrences FROM ln) SELECT md5(text) AS digest, container, line_no, occurrences FROM r WHERE k = 1")
def doc_lines_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.first_lines(_doc_lines(spark, sf_dir)).select(F.md5(F.col("text").cast("binary")).alias("digest"), "container", "line_no", "occurrences")


@query(f"WITH {LINES}, {OTHER} SELECT DISTINCT text FROM bl WHERE text NOT IN (SELECT text FROM ln)")
def line_missing_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_exact(_item_lines(spark, sf_dir), _doc_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT text, count(*) AS n FROM ln WHERE length(text) >= 8 GROUP BY text HAVING count(*) > 1")
def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.duplicates(_doc_lines(spark, sf_dir))


@query()
def line_fuzzy_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_fuzzy(_item_lines(spark, sf_dir), _doc_lines(spark, sf_dir))


@query(f"""WITH {LINES}, {OTHER}, a AS (SELECT DISTINCT text FROM ln), c AS (SELECT DISTINCT text FROM bl),
 n AS (SELECT (SELECT count(*) FROM a) AS n_source, (SELECT count(*) FROM c) AS n_stitched, (SELECT count(*) FROM a WHERE text NOT IN (FROM c)) AS missing, (SELECT count(*) FROM c WHERE text NOT IN (FROM a)) AS unmatched)
SELECT *, round(100 * (n_source - missing) / greatest(1, n_source), 2) AS recall, round(100 * (n_stitched - unmatched) / greatest(1, n_stitched), 2) AS precision FROM n""")
def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.report(_doc_lines(spark, sf_dir), _item_lines(spark, sf_dir), exact=True)


@query()
def reconcile_fuzzy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as the operator has it by default: a line counts as missing or unmatched if its best score is below 85."""
    return reconcile.report(_doc_lines(spark, sf_dir), _item_lines(spark, sf_dir))


def _tokens_sql(name: str, table: str) -> str:
    return f"{name} AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS token FROM {table}) WHERE length(token) >= 4 GROUP BY token)"


VOCAB = f"{_tokens_sql('s', 'documents')}, {_tokens_sql('t', 'conversations')}"


def _vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(reconcile.token_counts(read(spark, sf_dir, name), "text") for name in ("documents", "conversations"))


@query(f"WITH {VOCAB} SELECT token, n FROM s")
def token_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabularies(spark, sf_dir)[0]


@query(f"WITH {VOCAB} SELECT token, n FROM s WHERE token NOT IN (SELECT token FROM t)")
def token_only_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, stitched = _vocabularies(spark, sf_dir)
    return reconcile.only_in(source, stitched)


@query(f"WITH {VOCAB} SELECT token, n FROM t WHERE token NOT IN (SELECT token FROM s)")
def token_only_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, stitched = _vocabularies(spark, sf_dir)
    return reconcile.only_in(stitched, source)


@query(f"WITH {VOCAB} SELECT t.token, t.n AS n_stitched, coalesce(s.n, 0) AS n_source FROM t LEFT JOIN s USING (token) WHERE t.n >= 3 AND t.n >= 2 * greatest(1, coalesce(s.n, 0))")
def token_over_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.over_repeated(*_vocabularies(spark, sf_dir))


@query(f"""WITH {VOCAB}, n AS (SELECT (SELECT count(*) FROM s) AS n_source, (SELECT count(*) FROM t) AS n_stitched, (SELECT count(*) FROM s JOIN t USING (token)) AS shared)
SELECT *, round(100 * shared / greatest(1, n_source), 2) AS recall, round(100 * shared / greatest(1, n_stitched), 2) AS precision FROM n""")
def vocabulary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.vocabulary_report(*_vocabularies(spark, sf_dir))


@query("SELECT conv_id, md5(string_agg('<p class=\"' || role || '\">' || text || '</p>', chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id")
def view_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.sinks import html_view

    rows = read(spark, sf_dir, "conversations")
    item = F.concat(F.lit('<p class="'), "role", F.lit('">'), "text", F.lit("</p>"))
    return html_view.ordered_body(rows, ["conv_id"], "turn", item).select("conv_id", F.md5(F.col("body").cast("binary")).alias("digest"), "n")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows (the same expression runs on a stream, see streaming.rollup)."""
    from lumenreel.streaming.rollup import hourly

    return hourly(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query()
def stitch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-pass placement of frames: motion per user as the steps of a scroll."""
    from lumenreel.streaming.placing import place_batch

    frames = _motion(spark, sf_dir).select("user_id", "i", F.col("dv").cast("int").alias("dy"), F.lit(0.0).alias("sad"), F.lit(2.0).alias("conf"))
    return place_batch(frames, "user_id", height=100)


from lumenreel import pixels  # noqa: E402, F401  (registers its queries here)
