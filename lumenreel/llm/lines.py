"""Line dedup by a deletion-neighbourhood join; DataFrame operations only.

A line's symbols are its words.  Every line that holds a word takes part: an occurrence goes if an earlier one, by doc_id
and then by line number, has the same words, or, where both have at least ``MIN_WORDS`` words, is within one edit (a word
replaced, added or left out), whatever its length.  Of fewer words one edit would be a quarter of the line or more, so those
meet equal lines only.

Steps
    1. Equal lines collapse to their earliest occurrence.
    2. Four quarters of a line leave three untouched by one edit, aligned from the front or the back.  Each distinct line
       has a key for each such three quarters; only lines that share a key with another line go on.
    3. These emit their deletion neighbourhood as hashed keys: for each place where the shared key allows the edit, the
       line without that word, and the line itself.  A hash is the exclusive or of a hash of each word and its place, so
       that all variants come from running values, made in blocks of the root of their number.
    4. Equal variants meet: a replaced word where both lines lack the same place, an added one where a line equals a
       variant.  Of a meeting only the earliest line matters, so it is an aggregation that emits no pairs.
    5. The edit distance to that earliest line is verified on the words themselves.

Equal lines are told by 128 bits; a collision of the 64 bits of a variant could hide a link, never make one.

Results for odd input
    null text: no lines, stays null.  Empty text and blank lines stay.  null doc_id: after every number.  Rows that share
    a doc_id are one document as to the order; rows equal in doc_id and text get the same result.  A very long line:
    work grows as the power 1.5 of its words at most.  A document of many lines: linear work.  Empty table: no rows.
    Other columns: ignored by :func:`line_digests`, kept by :func:`dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import discard, durable, fresh, mark_maybe

#: Words that a line needs to be compared within an edit.
MIN_WORDS = 5
#: Parts of a line, of which one edit leaves all but one untouched, and keys of a line.
PARTS = 3
SLOTS = 2 * PARTS
#: Words of a part up to which a line's variants are hashed in one block.
WHOLE = 64

ORACLE = f"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
     l AS (SELECT doc_id, line_no, line, [x FOR x IN regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM raw),
     e AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id NULLS LAST, line_no) AS r FROM l WHERE len(w) > 0),
     u AS (SELECT w, any_value(n) AS n, min(r) AS r FROM e GROUP BY w),
     f AS (SELECT * FROM u WHERE n >= {MIN_WORDS}),
     c AS (SELECT DISTINCT a.r AS ar, b.r AS br FROM f a JOIN f b ON a.w[1:2] = b.w[1:2] AND b.r < a.r AND abs(a.n - b.n) <= 1
           UNION SELECT DISTINCT a.r, b.r FROM f a JOIN f b ON a.w[-2:] = b.w[-2:] AND b.r < a.r AND abs(a.n - b.n) <= 1),
     p AS (SELECT a.r, a.w AS x, b.w AS y FROM c JOIN u a ON a.r = ar JOIN u b ON b.r = br),
     near AS (SELECT DISTINCT r FROM p WHERE
          (len(x) = len(y) AND len([i FOR i IN range(1, len(x) + 1) IF x[i] <> y[i]]) = 1)
       OR (len(x) = len(y) + 1 AND len([i FOR i IN range(1, len(x) + 1) IF list_concat(x[1:i - 1], x[i + 1:]) = y]) > 0)
       OR (len(y) = len(x) + 1 AND len([i FOR i IN range(1, len(y) + 1) IF list_concat(y[1:i - 1], y[i + 1:]) = x]) > 0)),
     gone AS (SELECT e.doc_id, e.line_no FROM e JOIN u ON e.w = u.w LEFT JOIN near ON near.r = u.r WHERE e.r > u.r OR near.r IS NOT NULL),
     kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL) AS t,
                     count(*) AS n_lines, count(g.line_no) AS n_dropped
              FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars, sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def _lines(docs: DataFrame) -> DataFrame:
    """All lines: doc_id, th (hash of the text), line_no, line (words with one space between)."""
    # most texts hold single spaces only and need no regular expression
    odd = " OR ".join(["startswith(text, ' ')", "endswith(text, ' ')", *[f"contains(text, '{x}')" for x in ("  ", " \\n", "\\n ")], *[f"contains(text, chr({c}))" for c in (9, 11, 12, 13)]])
    single = r"btrim(regexp_replace(regexp_replace(text, '[\\x20\\x09\\x0B-\\x0D]+', ' '), ' ?\\n ?', '\n'), ' ')"
    doc = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.expr(f"IF({odd}, {single}, text)").alias("text"))
    return doc.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hash(line: str) -> Column:
    return F.xxhash64(line)


def _place(rows: DataFrame) -> Callable[[str, str], Column]:
    """Of all lines (doc_id, line_no): an expression for a line's place in their order, as one number.

    A long where the ranges of both fit, else a decimal; the order is the same.
    """
    low, high, lines = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first()
    low, high, shift = low or 0, high or 0, (lines or 0).bit_length()
    if (high - low + 2) << shift < 1 << 62:
        return lambda doc_id, line_no: (F.coalesce(F.col(doc_id), F.lit(high + 1)) - F.lit(low)) * F.lit(1 << shift) + F.col(line_no).cast("long")
    last = F.expr("cast('9223372036854775808' AS decimal(19,0))")
    return lambda doc_id, line_no: F.coalesce(F.col(doc_id).cast("decimal(19,0)"), last) * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col(line_no).cast("decimal(10,0)")


def _sized(lines: DataFrame) -> DataFrame:
    """Adds n (words of ``line``) and q0, q1: words of a part, if an edit adds a word or replaces one, or leaves one out.

    Lines one word longer or shorter have parts of the same size either for their own length or for one word less;
    q1 is null where it makes no difference, both are for lines of too few words.
    """
    lines = lines.withColumn("n", F.expr("octet_length(line) - octet_length(replace(line, ' ', '')) + 1"))
    lines = lines.withColumn("q0", F.expr(f"IF(n >= {MIN_WORDS}, cast((n - 1) div {PARTS} AS int), NULL)"))
    return lines.withColumn("q1", F.expr(f"IF(n > {MIN_WORDS} AND (n - 2) div {PARTS} != (n - 1) div {PARTS}, cast((n - 2) div {PARTS} AS int), NULL)"))


def _ends(slot: int) -> tuple[int, int, str]:
    """Untouched parts at the front and at the back that a slot's key stands for, and the column with a part's words."""
    front = PARTS - 1 - slot % PARTS
    return front, PARTS - 1 - front, f"q{slot // PARTS}"


def _key(slot: int) -> str:
    """Key of all but one of a line's parts.  They are stretches of the line itself, so keys need no array of words."""
    front, back, q = _ends(slot)
    used = [f"substring_index(line, ' ', {front} * {q})"] * (front > 0) + [f"substring_index(line, ' ', -{back} * {q})"] * (back > 0)
    return f"IF({q} IS NULL, NULL, xxhash64({front}, {q}, {', '.join(used)}))"


def _slots(lines: DataFrame, *columns: str) -> DataFrame:
    """A row for each key of ``lines`` (k0, k1 ...): bit, key."""
    keys = F.array(*[F.struct(F.lit(1 << s).cast("long").alias("bit"), F.col(f"k{s}").alias("key")) for s in range(SLOTS)])
    return lines.where("k0 IS NOT NULL").select(*columns, F.explode(keys).alias("slot")).select(*columns, "slot.*").where("key IS NOT NULL")


def _variants(found: DataFrame) -> DataFrame:
    """The deletion neighbourhood of ``found`` (h, first, mask, line): k (hash of what is left), kind, h, first.

    kind 0: a word left out, meets its like; 1: the line itself, 2: a word left out, meets the other.

    Only the words between a key's ends vary.  Where they are many they are cut into blocks of the root of their number;
    what lies before and after a block is hashed once for all its variants.  A line itself has a variant for each
    block of a line with one word more.
    """
    parts = []
    for s in range(SLOTS):
        front, back, q = _ends(s)
        parts.append(f"named_struct('bit', {1 << s}L, 'key', {_key(s)}, 'm', n - {front + back} * {q}, 'mid', substring_index(substring_index(line, ' ', n - {back} * {q}), ' ', {front} * {q} - (n - {back} * {q})), 'size', IF({q} <= {WHOLE}, {2 * WHOLE}, cast(ceil(sqrt({q})) AS int)))")
    lines = _sized(found).select("h", "first", "mask", F.expr(f"explode(array({', '.join(parts)}))").alias("p")).where("(mask & p.bit) != 0").select("h", "first", "p.*")
    # own: words of the line that the block belongs to, its own or one more
    lines = lines.select("*", F.expr("explode(array(m, m + 1))").alias("own"))
    lines = lines.select("*", F.expr("explode(sequence(0, (own - 1) div size))").alias("b")).withColumn("from", F.expr("b * size")).withColumn("to", F.expr("least(from + size, own)"))
    around = "xxhash64(key, own, b, substring_index(mid, ' ', from), IF(to = own, '', substring_index(mid, ' ', to - own)))"
    inside = "IF(from >= to - own + m, '', substring_index(substring_index(mid, ' ', to - own + m), ' ', from - (to - own + m)))"
    lines = lines.select("h", "first", F.expr("own = m").alias("edited"), F.expr("to - from").alias("n"), F.expr(around).alias("around"), F.expr(inside).alias("inside"))
    lines = lines.select("*", F.expr("explode(IF(edited, sequence(0, n - 1), array(-1)))").alias("at"))
    left = "IF(edited, btrim(concat(substring_index(inside, ' ', at), ' ', IF(at = n - 1, '', substring_index(inside, ' ', at - n + 1))), ' '), inside)"
    lines = lines.select("h", "first", "edited", "at", F.expr(f"xxhash64(around, {left})").alias("k"))
    kinds = F.explode(F.expr("IF(edited, array(2, 0), array(1))")).alias("kind")
    return lines.select("h", "first", "at", "k", kinds).select("h", "first", "kind", F.expr("IF(kind = 0, xxhash64(k, at), k)").alias("k"))


def _near(docs: DataFrame, firsts: DataFrame, place: Callable[[str, str], Column]) -> DataFrame:
    """Distinct lines (h, first) of ``firsts`` that have an earlier line within one edit."""
    keys = _slots(firsts, "h", "first")
    shared = durable(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select(F.col("key").alias("s_key")))
    keys = mark_maybe(keys, "key", shared, "s_key", "maybe").where("maybe").drop("maybe")
    going = keys.join(shared, F.col("key") == F.col("s_key")).groupBy("h", "first").agg(F.bit_or("bit").alias("mask"))
    going = durable(going.select(F.col("h").alias("c_h"), F.col("first").alias("c_first"), "mask", F.xxhash64("first").alias("c_place")))
    discard(shared)

    lines = _lines(docs).withColumn("first", place("doc_id", "line_no")).withColumn("place", F.xxhash64("first"))
    lines = mark_maybe(lines, "place", going, "c_place", "maybe").where("maybe").select("first", "line")
    lines = lines.withColumn("h", _hash("line"))
    found = lines.join(going, F.expr("first = c_first AND h = c_h")).select("h", "first", "mask", "line")
    found = durable(found.dropDuplicates(["h", "first"]))
    discard(going)

    variants = _variants(found)
    one, other = F.min(F.when(F.col("kind") != 2, F.col("first"))), F.min(F.when(F.col("kind") == 2, F.col("first")))
    met = variants.groupBy("k").agg(one.alias("m0"), other.alias("m1"), F.max("first").alias("top"))
    met = durable(met.where("(m1 IS NOT NULL AND m0 IS NOT NULL) OR (m1 IS NULL AND top > m0)").select(F.col("k").alias("m_k"), "m0", "m1"))
    seen = mark_maybe(variants, "k", met, "m_k", "maybe").where("maybe").drop("maybe").join(met, F.col("k") == F.col("m_k"))
    seen = seen.withColumn("earlier", F.when(F.col("kind") == 1, F.col("m1")).otherwise(F.col("m0"))).where("earlier < first")
    pairs = seen.select("h", "first", "earlier").distinct()
    mine = found.select(F.col("h").alias("x_h"), F.col("first").alias("x_first"), F.split("line", " ").alias("x"))
    theirs = found.select(F.col("first").alias("y_first"), F.split("line", " ").alias("y"))
    pairs = pairs.join(mine, F.expr("h = x_h AND first = x_first")).join(theirs, F.expr("earlier = y_first"))
    near = durable(pairs.where(_within_one_edit("x", "y")).select("h", "first").distinct())
    discard(met)
    discard(found)
    return near


def _within_one_edit(x: str, y: str) -> Column:
    """Edit distance of two word arrays at most one: after the first difference, the rests agree."""
    p = f"(CASE WHEN array_position(zip_with({x}, {y}, (a, b) -> a <=> b), false) = 0 THEN least(size({x}), size({y})) ELSE cast(array_position(zip_with({x}, {y}, (a, b) -> a <=> b), false) AS int) - 1 END)"
    rest = lambda a, skip: f"slice({a}, {p} + {1 + skip}, size({a}))"
    return F.expr(f"CASE WHEN size({x}) = size({y}) THEN {rest(x, 1)} = {rest(y, 1)} WHEN size({x}) = size({y}) + 1 THEN {rest(x, 1)} = {rest(y, 0)} WHEN size({y}) = size({x}) + 1 THEN {rest(x, 0)} = {rest(y, 1)} ELSE false END")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """Per text that loses lines: d_doc_id, d_th (hash of the text), n_gone, and gone: a byte for each line up to the last
    that goes, '1' for those that do."""
    lines = _sized(_lines(docs).where("line != ''"))
    lines = lines.withColumn("h", _hash("line")).withColumn("g", F.xxhash64(F.lit(1), "line", F.lit(2)))
    rows = durable(lines.select("doc_id", "th", "line_no", "h", "g", *[F.expr(_key(s)).alias(f"k{s}") for s in range(SLOTS)]))
    place = _place(rows)
    firsts = rows.groupBy("h", "g").agg(F.min(place("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("times"), *[F.min(f"k{s}").alias(f"k{s}") for s in range(SLOTS)])
    firsts = durable(firsts)
    near = _near(docs, firsts, place)
    close = near.select(F.col("h").alias("n_h"), F.col("first").alias("n_first"), F.lit(True).alias("near"))
    judged = firsts.join(close, F.expr("h = n_h AND first = n_first"), "left").where("times > 1 OR near")
    judged = judged.select(F.col("h").alias("j_h"), F.col("g").alias("j_g"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = rows.join(judged, F.expr("h = j_h AND g = j_g")).where(F.col("near") | (place("doc_id", "line_no") > F.col("first")))
    # a document's lines: bounded by its text.  Repeated rows bring a line more than once.
    held = gone.groupBy(F.col("doc_id").alias("d_doc_id"), F.col("th").alias("d_th")).agg(F.collect_set("line_no").alias("l"))
    flags = "array_join(zip_with(sort_array(l), concat(array(-1), sort_array(l)), (x, p) -> IF(x IS NULL, '', concat(repeat('0', x - p - 1), '1'))), '')"
    out = durable(held.select("d_doc_id", "d_th", F.size("l").alias("n_gone"), F.expr(flags).cast("binary").alias("gone")))
    for done in (rows, firsts, near):
        discard(done)
    return out


def _kept(text: str, gone: str) -> Column:
    return F.expr(f"array_join(filter(split({text}, '\\n', -1), (x, i) -> substring({gone}, i + 1, 1) != X'31'), '\\n')")


def _marked(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame, str, str]:
    """``docs`` in two: rows whose text surely stays, and the others with n_gone and gone (null if it stays after all)."""
    th, maybe, d_doc, d_th, gone, n_gone = fresh(docs, "line_th", "line_maybe", "line_doc", "line_dth", "line_gone", "line_n_gone")
    lost = lost.select(F.col("d_doc_id").alias(d_doc), F.col("d_th").alias(d_th), F.col("gone").alias(gone), F.col("n_gone").alias(n_gone))
    marked = mark_maybe(docs.withColumn(th, F.xxhash64("text")), th, lost, d_th, maybe)
    loses = marked.where(F.col(maybe)).join(lost, (F.col(th) == F.col(d_th)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d_doc)), "left")
    return marked.where(~F.col(maybe)).select(*docs.columns), loses.drop(th, maybe, d_doc, d_th), gone, n_gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with such lines left out of ``text`` (and ``n_chars``, if there, as it then is)."""
    same, loses, gone, _ = _marked(docs, dropped_lines(docs.select("doc_id", "text")))
    loses = loses.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(_kept("text", gone)))
    if "n_chars" in docs.columns:
        loses = loses.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return same.unionByName(loses.select(*docs.columns))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, and n_chars and text_sha256 of the text that stays."""
    before = docs.select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines")
    same, loses, gone, n_gone = _marked(before, dropped_lines(before))
    loses = loses.select("doc_id", n_lines, F.coalesce(n_gone, F.lit(0)).alias("n_dropped"), F.when(F.col(gone).isNull(), F.col("text")).otherwise(_kept("text", gone)).alias("text"))
    rows = same.select("doc_id", n_lines, F.lit(0).alias("n_dropped"), "text").unionByName(loses)
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
