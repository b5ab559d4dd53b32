"""Sharding by extendible hashing; DataFrame operations only.

A document's hash is the first 60 bits of the MD5 of its doc_id's text.  A shard is a prefix of that hash: starting from
no bits, a bucket splits on one more bit while its documents' UTF-8 bytes are above the limit
(:mod:`lumenreel.llm.directory`).  Only document sizes are aggregated; texts don't move until shards are written.

Results for odd input
    null text: 0 bytes.  A document larger than the limit: a shard of its own
    (rows of one doc_id that each are: the same one).  null doc_id: hashed as empty text.
    Documents of one hash (repeated rows) that are together above the limit: overflow pages in the bucket, filled in
    reading order, each within the limit.  Empty table: no rows.  Other columns: ignored by :func:`assign`, kept by
    :func:`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm import directory
from lumenreel.llm.common import durable, fresh

LIMIT = 256 << 20
#: The registered query splits down to this, so that its tables give more than a few shards.
QUERY_LIMIT = 1 << 20

ORACLE = f"""
WITH t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
     d AS (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d),
     nodes AS (SELECT d, h >> (60 - d) AS q, sum(n) AS w FROM t, d WHERE n <= {QUERY_LIMIT} GROUP BY ALL),
     leaves AS (SELECT t.doc_id, min(d) AS depth FROM t JOIN nodes ON q = h >> (60 - d) WHERE w <= {QUERY_LIMIT} AND n <= {QUERY_LIMIT} GROUP BY ALL),
     named AS (SELECT t.doc_id, n, depth, CASE WHEN depth IS NULL THEN 'large-' || lpad(to_hex(h), 15, '0')
                      ELSE 'bits-' || array_to_string([CAST((h >> CAST(59 - i AS INTEGER)) & 1 AS VARCHAR) FOR i IN range(0, depth)], '') END AS shard
               FROM t LEFT JOIN leaves USING (doc_id))
SELECT doc_id, shard, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n_bytes, CAST(sum(n) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes FROM named
"""


def _located(docs: DataFrame, limit: int, *more: str) -> DataFrame:
    """doc_id, n_bytes, shard, depth and the columns ``more`` of ``docs``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.monotonically_increasing_id().alias("uid"), directory.hash60_of_text(F.col("doc_id")).alias("h"), *more)
    rows = durable(rows)
    whole = rows.where(F.col("n_bytes") <= limit)
    entries = directory.build(whole.select("h", F.col("n_bytes").alias("w")), limit)
    found = directory.locate(whole, entries)
    prefix = F.expr(f"shiftright(h, {directory.BITS} - depth)")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    fits = found.where("depth IS NOT NULL").withColumn("shard", F.concat(F.lit("bits-"), bits))
    name = F.lower(F.lpad(F.hex("h"), 15, "0"))
    large = rows.where(F.col("n_bytes") > limit).withColumn("depth", F.lit(None).cast("int")).withColumn("shard", F.concat(F.lit("large-"), F.upper(name)))
    # one hash, too many bytes: pages by a running sum that is made per part of the input, then over the parts
    over = found.where("depth IS NULL").withColumn("part", F.shiftright("uid", 33))
    parts = over.groupBy("h", "part").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("most"))
    by = W.partitionBy("h").orderBy("part")
    parts = parts.withColumn("before", F.sum("bytes").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")).withColumn("most", F.max("most").over(W.partitionBy("h")))
    over = over.join(parts.select(F.col("h").alias("o_h"), F.col("part").alias("o_part"), "before", "most"), F.expr("h = o_h AND part = o_part"))
    start = F.col("before") + F.sum("n_bytes").over(W.partitionBy("h", "part").orderBy("uid").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_bytes")
    page = F.floor(start / F.greatest(F.lit(1), F.lit(limit) - F.col("most") + 1)).cast("string")
    over = over.withColumn("shard", F.concat(F.lit("page-"), name, F.lit("-"), page))
    columns = ["doc_id", "n_bytes", "shard", "depth", "uid", *more]
    return fits.select(*columns).unionByName(large.select(*columns)).unionByName(over.select(*columns))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, shard, depth, n_bytes, shard_bytes."""
    rows = _located(docs, limit)
    total = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes")).withColumnRenamed("shard", "t_shard")
    return rows.join(total, F.col("shard") == F.col("t_shard")).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes ``docs`` as Parquet under ``path``, a folder ``shard=...`` for each shard."""
    shard, = fresh(docs, "shard")
    names = [c for c in docs.columns if c not in ("doc_id",)]
    boxed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("box")) if names else docs
    rows = _located(boxed, limit, "box").select("box.*", F.col("shard").alias(shard))
    rows.repartition(shard).write.partitionBy(shard).parquet(path)
