"""Exact dedup over an extendible-hash index kept on shared files; DataFrame operations only.

Texts are keyed by a 64-bit hash and a SHA-256.  A directory of hash prefixes (:mod:`lumenreel.llm.directory`), built from
counts of distinct keys, splits only buckets that hold too many; rows are dealt by bucket, so that an owner task holds a
range of keys and groups what it owns.  Equal keys collapse into ``LANES`` rows at most before they are dealt, so a group
with a third of all rows costs its owner no more than any other.

Where rows share a key the owner compares bytes: it groups the texts themselves, and a key with more than one text is a
chain.  Only texts whose key is shared travel for that, once: a bitmap of at most 8 MB, whatever the input, drops nearly
all others where they are read, and texts of keys with more than ``HOT`` rows collapse before they are dealt.  Rows of
chained keys are then grouped by the bytes alone.

Results for odd input
    null text: equals empty text.  null doc_id: ranks below every number; where all of a group are null, keep_id is
    null and one row stays.  Repeated rows (one doc_id): exactly one of a group's rows is kept.  Very long text: hashed and
    compared whole.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm import directory
from lumenreel.llm.common import discard, durable, mark_maybe

#: Distinct keys, by estimate, that a bucket of the index holds before it splits.
BUCKET_KEYS = 20_000
#: Rows into which equal keys collapse before they are dealt, and rows of a key from which its texts collapse first too.
LANES, HOT = 16, 64

ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, weak: Callable[[Column], Column], strong: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), weak(text).alias("key"), strong(text).alias("s"))


def _dealt(rows: DataFrame, entries: list, *values: str) -> DataFrame:
    """``rows`` dealt to the owners of their buckets: depth, bucket, key, s and ``values``."""
    found = directory.locate(rows.withColumn("h", F.shiftrightunsigned("key", 4)), entries)
    bucket = F.expr(f"shiftright(h, {directory.BITS} - coalesce(depth, {directory.BITS}))")
    return found.withColumn("bucket", bucket).select("depth", "bucket", "key", "s", *values).repartition("depth", "bucket")


OWNED = ["depth", "bucket", "key", "s"]


def build_index(rows: DataFrame) -> tuple[DataFrame, list]:
    """The index of ``rows`` (doc_id, uid, key, s) on shared files, and its directory.

    Per key: its bucket, staying row and size, each bucket grouped by the task that owns it.
    """
    cells = rows.groupBy(F.shiftrightunsigned("key", 4 + directory.BITS - directory.STEP).alias("cell")).agg(F.approx_count_distinct("key").alias("n"))
    # a cell is a prefix of STEP bits; one that alone is too full is looked at by rows of its keys
    full = cells.where(F.col("n") > BUCKET_KEYS).select("cell")
    deep = rows.join(F.broadcast(full), F.shiftrightunsigned("key", 4 + directory.BITS - directory.STEP) == F.col("cell"), "left_semi").groupBy("key").agg(F.lit(1).alias("w"))
    weights = cells.join(F.broadcast(full), "cell", "left_anti").select(F.shiftleft("cell", directory.BITS - directory.STEP).alias("h"), F.col("n").alias("w"))
    weights = durable(weights.unionAll(deep.select(F.shiftrightunsigned("key", 4).alias("h"), "w")))
    entries = directory.build(weights, BUCKET_KEYS)
    discard(weights)
    lanes = rows.groupBy("key", "s", F.pmod(F.shiftright("uid", 33), F.lit(LANES)).alias("lane")).agg(F.max(F.struct("doc_id", "uid")).alias("stay"), F.count(F.lit(1)).alias("n"))
    owned = _dealt(lanes, entries, "stay", "n").groupBy(*OWNED).agg(F.max("stay").alias("stay"), F.sum("n").alias("n"))
    return durable(owned), entries


def exact_dedup(docs: DataFrame, weak: Callable[[Column], Column] = F.xxhash64, strong: Callable[[Column], Column] = _sha256) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, s; of equal texts the largest doc_id stays.

    ``weak``, ``strong``: the two digests of a key (tests pass poor ones, so that chains arise).
    """
    keyed = _keyed(docs, weak, strong)
    rows = durable(keyed.select("doc_id", F.monotonically_increasing_id().alias("uid"), "key", "s"))
    index, entries = build_index(rows)
    shared = index.where("n > 1")
    out = rows.join(shared.select(F.col("key").alias("k_key"), F.col("s").alias("k_s"), "stay", "n"), F.expr("key = k_key AND s = k_s"), "left")
    chained = durable(_chained(keyed, shared, entries))
    if not chained.isEmpty():
        keys = chained.select(F.col("key").alias("c_key"), F.col("s").alias("c_s"))
        out = out.join(keys, F.expr("key = c_key AND s = c_s"), "left_anti")
        apart = keyed.join(keys, F.expr("key = c_key AND s = c_s"), "left_semi")
        apart = durable(apart.select("doc_id", F.monotonically_increasing_id().alias("uid"), "key", "s", "text"))
        texts = apart.groupBy("key", "s", "text").agg(F.max(F.struct("doc_id", "uid")).alias("stay"), F.count(F.lit(1)).alias("n"))
        texts = texts.select(*[F.col(c).alias(f"k_{c}") for c in ("key", "s", "text")], "stay", "n")
        out = out.unionByName(apart.join(texts, F.expr("key = k_key AND s = k_s AND text = k_text")).select(*[F.col(c) for c in ("doc_id", "uid", "key", "s")], "k_key", "k_s", "stay", "n"))
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("stay.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("stay.uid") == F.col("uid"))).alias("kept"),
        "s",
    )


def _chained(keyed: DataFrame, shared: DataFrame, entries: list) -> DataFrame:
    """Keys (key, s) of more than one text, by the owners' comparison of bytes."""
    hot = shared.where(F.col("n") > HOT).select(F.col("key").alias("hot_key"))
    near = mark_maybe(keyed.select("key", "s", "text"), "key", shared.select(F.col("key").alias("s_key")), "s_key", "near").where("near").drop("near")
    near = mark_maybe(near, "key", hot, "hot_key", "hot")
    once = near.where("hot").groupBy("key", "s", "text").agg(F.count(F.lit(1)).alias("n")).select("key", "s", "text")
    texts = near.where("NOT hot").select("key", "s", "text").unionAll(once)
    owned = _dealt(texts, entries, "text").groupBy(*OWNED, "text").agg(F.count(F.lit(1)).alias("n"))
    return owned.groupBy(*OWNED).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key", "s")
