"""Extendible hashing as DataFrame operations: a directory of hash prefixes in which only overfull buckets split.

Hashes are non-negative 60-bit longs.  A bucket is a prefix of ``depth`` bits; it splits on the next bit while its
weight is above the limit.  Weights are summed per 12-bit prefix first (at most 4096 rows, whatever the input), rolled
up to every depth, and only what is still overfull is looked at again with 12 more bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import durable

BITS, STEP = 60, 12
#: Directory entries up to which a step's part of the directory is broadcast.
SMALL = 65_536


def hash60_of_text(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text (null counts as empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def build(weights: DataFrame, limit: int) -> list[tuple[int, DataFrame, int]]:
    """The directory of ``weights`` (h, w): per step (bits, entries (p, depth), number of entries).

    ``depth`` null: overfull at that many bits, see the next step; still null after the last one: all of one hash.
    """
    out: list[tuple[int, DataFrame, int]] = []
    left = weights
    for bits in range(STEP, BITS + 1, STEP):
        cells = left.groupBy(prefix(F.col("h"), bits).alias("p")).agg(F.sum("w").alias("w"))
        # the cells of one bucket of the step before: at most 2 ** STEP rows, rolled up by a window for each depth
        node = lambda d: W.partitionBy(F.expr(f"shiftright(p, {STEP})"), F.expr(f"shiftright(p, {bits} - {d})"))
        least = F.least(*[F.when(F.sum("w").over(node(d)) <= limit, d) for d in range(bits - STEP, bits + 1)])
        entries = durable(cells.select("p", least.cast("int").alias("depth")))
        counts = entries.agg(F.count(F.lit(1)), F.count("depth")).first()
        out.append((bits, entries, counts[0]))
        if counts[0] == counts[1]:
            break
        full = entries.where("depth IS NULL").select("p")
        left = left.withColumn("p", prefix(F.col("h"), bits)).join(full if counts[0] > SMALL else F.broadcast(full), "p", "left_semi").drop("p")
    return out


def locate(rows: DataFrame, directory: list[tuple[int, DataFrame, int]], depth: str = "depth") -> DataFrame:
    """``rows`` (with h) and the depth of each one's bucket; null where a bucket of one hash stays overfull."""
    found = []
    for k, (bits, entries, n) in enumerate(directory):
        entries = entries.where("depth IS NOT NULL").select(F.col("p").alias(f"_p{k}"), F.col("depth").alias(f"_d{k}"))
        rows = rows.withColumn(f"_q{k}", prefix(F.col("h"), bits))
        rows = rows.join(F.broadcast(entries) if n <= SMALL else entries, F.col(f"_q{k}") == F.col(f"_p{k}"), "left").drop(f"_p{k}", f"_q{k}")
        found.append(f"_d{k}")
    return rows.withColumn(depth, F.coalesce(*found)).drop(*found)
