"""What the operators of this subpackage share: inputs, durable tables, column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else, in local mode only, one set here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenreel-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenreel-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # most columns are hashes or unique
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a :func:`durable` table that nothing will read again."""
    path = getattr(df, "_durable_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(column: str, n: int) -> Column:
    """``crc32`` of the column's decimal text, modulo ``n`` (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of one bitmap of Spark's bitmap_construct_agg, and the most that a filter has (8 MB, whatever the input).
SLICE, FILTER_BITS = 32_768, 26


def mark_maybe(rows: DataFrame, h: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds ``flag``: false if ``rows.h`` (a 64-bit hash) is in no row of ``keys.key``, else true or, rarely, false alarm.

    A bitmap of the keys' leading bits, of bounded size, goes to every task; nothing is shuffled.  It goes as arrays
    of longs, of which a task reads one in place, where binary values would be copied for every row.
    """
    b_slice, b_words, b_cell = fresh(rows, "b_slice", "b_words", "b_cell")
    bits = min(FILTER_BITS, max(15, (16 * max(1, keys.count())).bit_length()))
    cells = keys.select(F.shiftrightunsigned(key, 64 - bits).alias("cell")).select(F.expr(f"cell div {SLICE}").alias(b_slice), F.expr(f"cast(cell % {SLICE} AS int)").alias("place"))
    bitmap = cells.groupBy(b_slice).agg(F.expr("bitmap_construct_agg(place)").alias("bits"))
    words = F.expr(f"transform(sequence(0, {SLICE // 64 - 1}), w -> cast(conv(hex(substring(bits, 8 * w + 1, 8)), 16, -10) AS bigint))")
    bitmap = bitmap.select(b_slice, words.alias(b_words))
    out = rows.withColumn(b_cell, F.shiftrightunsigned(h, 64 - bits))
    out = out.join(F.broadcast(bitmap), F.expr(f"{b_cell} div {SLICE} = {b_slice}"), "left")
    # bytes of a word are in reading order, the bits of a byte from the lowest
    hit = F.expr(f"coalesce(shiftrightunsigned({b_words}[cast({b_cell} % {SLICE} div 64 AS int)], cast(56 - {b_cell} % 64 div 8 * 8 + {b_cell} % 8 AS int)) & 1, 0) = 1")
    return out.withColumn(flag, hit).drop(b_cell, b_slice, b_words)
