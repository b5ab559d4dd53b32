"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits form a ring of eight segments.  If two fingerprints differ in at most two bits, some segment
starts a chain whose cumulative differences stay within the proportional budget at every length (``length * 2 / 8``):
its first three segments are equal, the first seven differ in at most one bit, all eight in at most two.  Candidates meet
on three equal consecutive segments (eight 24-bit keys a fingerprint); the chain budget, then the full Hamming
distance, are conditions of the join, so that only links leave it.

Equal fingerprints collapse first.  A key that more than ``CROWD`` distinct fingerprints share (near copies by the
thousand) isn't joined with itself: there each fingerprint emits itself and its neighbours at one flipped bit of the
other 40, and fingerprints that meet on a neighbour differ in two bits at most.  That finds exactly the same
components with 41 rows a fingerprint, where all pairs would grow with the square of the crowd.

Results for odd input
    null or empty text, or only white space: fingerprint zero, linked like any other.  null doc_id: its row is part of
    its group, whose component_id is the smallest doc_id that isn't null (null if there is none).  Repeated rows: one
    result each.  Different texts under one doc_id: each is in the group of its own text.  :func:`near_dedup` keeps one row
    of a group: of the smallest doc_id (null last), then of the smallest hash of the text, then of all columns.  Empty table:
    no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import durable, fresh
from lumenreel.llm.components import components

SHINGLE, SEED, SEGMENTS, DISTANCE = 3, 42, 8, 2
#: Distinct fingerprints under one key beyond which its links are found through flipped bits.
CROWD = 200


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: majority bits of its shingles' XXH64, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        starts = [0, *ends[:-SHINGLE]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    whole = np.array(hashes, "<u8")
    for at in range(0, len(whole), 65_536):
        ones += np.unpackbits(whole[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, th (hash of the text), f (the fingerprint as a long)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = pa.array([fingerprint(t.as_py() or b"") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], out], ["doc_id", "th", "f"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, th long, f long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Of distinct fingerprints f: pairs (a, b) that connect what lies within ``DISTANCE`` bits."""
    width = 64 // SEGMENTS
    ring = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i")
    turned = F.expr(f"shiftleft(f, i * {width}) | CASE WHEN i = 0 THEN 0L ELSE shiftrightunsigned(f, 64 - i * {width}) END")
    keyed = prints.select("f", ring).withColumn("turned", turned).withColumn("key", F.shiftrightunsigned("turned", 64 - 3 * width))
    met = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(keyed.join(met, ["i", "key"]))
    few = shared.where(F.col("n") <= crowd).select("i", "key", "f", "turned")
    x, y = few.alias("x"), few.alias("y")
    differs = "x.turned ^ y.turned"
    chain = f"x.f < y.f AND bit_count(shiftrightunsigned({differs}, {width})) <= {(SEGMENTS - 1) * DISTANCE // SEGMENTS} AND bit_count({differs}) <= {DISTANCE}"
    near = x.join(y, F.expr(f"x.i = y.i AND x.key = y.key AND {chain}")).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    rest = 64 - 3 * width
    flips = F.expr(f"explode(concat(array(turned), transform(sequence(0, {rest - 1}), b -> turned ^ shiftleft(1L, b))))")
    many = shared.where(F.col("n") > crowd).select("i", "key", "f", flips.alias("near"))
    hubs = many.groupBy("i", "key", "near").agg(F.min("f").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    crowded = many.join(hubs, ["i", "key", "near"]).where("f != b").select(F.col("f").alias("a"), "b")
    return near.unionAll(crowded).distinct()


def _classes(rows: DataFrame, least: Column, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints of ``rows``: f, least (an aggregate of the rows with it), label (equal within a component)."""
    prints = durable(rows.groupBy("f").agg(least.alias("least")))
    found = components(links(prints.select("f"), crowd))
    return prints.join(found, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("label"))


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links)."""
    rows = durable(fingerprints(docs))
    classes = _classes(rows, F.min("doc_id"), crowd)
    ids = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "label").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group."""
    id_, th, k_id, k_th, one = fresh(docs, "near_id", "near_th", "keep_id", "keep_th", "near_one")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    kept = _classes(durable(fingerprints(docs)), first).groupBy("label").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias(k_id), F.col("least.th").alias(k_th)).distinct()
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text"))
    rows = rows.join(kept, F.col(id_).eqNullSafe(F.col(k_id)) & (F.col(th) == F.col(k_th)), "left_semi")
    # repeated rows
    by = W.partitionBy(id_, th).orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(one, F.row_number().over(by)).where(f"{one} = 1").select(*docs.columns)
