"""Embedding near-dedup with randomised-rotation binary codes.

Each unit vector is turned by several random rotations; the signs of its coordinates are its codes, and with each of the
first ``USED`` codes goes the inner product of the vector with its code's direction, the correction factor.  A code divided by
its factor, turned back, is the vector plus an error at right angles to it, of known length and random direction.  So
the inner product of one vector's code with another's code *of another rotation* is an unbiased estimate of the cosine; the
mean over all pairs of rotations has a confidence bound that follows from the factors.  Only pairs whose upper bound reaches
the threshold are recomputed, exactly, in double precision; only these exact values decide.

Which pairs are looked at: vectors meet in tables, each keyed by code bits of its own.  Bits per table grow with the logarithm
of the number of vectors, so a bucket holds about as many vectors at any size; the number of tables is what makes a pair at
the threshold meet with probability ``RECALL``, at any size; a pair that meets in no table is lost.  A pair counts in the
first table where it meets, which its codes tell, so nothing has to be brought together to count it once.

What is dealt to the tables is a number, codes and factors, a fraction of a vector.  A task returns which of a bucket's
vectors have a pair to recompute; only these are fetched, to the buckets that need them.  Equal vectors collapse before
anything is compared.  A bucket of more than ``BLOCK`` vectors is compared block by block in separate tasks.  Tasks return a row
per vector, not per pair.

Results for odd input
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Vectors of different length
    never link.  Repeated rows: each counts as another vector.  Different vectors under one vec_id: linked only as their
    values are.  null vec_id: links count, also between others; component_id is the smallest that isn't null (null if there is
    none), kept false.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import discard, durable
from lumenreel.llm.components import components

THRESHOLD, RECALL, SEED = 0.95, 0.9999, 11
BLOCK = 512
#: Rotations whose codes are used for estimates, and standard errors of an estimate that count as its bound.
USED, SURE = 4, 4.0
#: Entries up to which the list of crowded buckets is broadcast.
SMALL = 65_536


def shape_of_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = min(40, max(4, round(math.log2(max(2, n))) - 7))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


#: Rotations made so far, by dimension and seed (a plain dictionary: functions travel to workers by value).
_MADE: dict[tuple[int, int], list[np.ndarray]] = {}


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions."""
    out = _MADE.setdefault((dim, seed), [])
    for k in range(len(out), count):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out[:count])


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row of a list column as a unit vector, None where it can't be."""
    out: list[np.ndarray | None] = []
    for row in column:
        values = row.as_py() if row.is_valid else None
        if not values or any(v is None for v in values):
            out.append(None)
            continue
        x = np.array(values, float)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt(x @ x))
    return out


def rotations_needed(dim: int, bits: int, tables: int) -> int:
    return max(2, -(-bits * tables // dim))


def encode(units: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of packed bits, one rotation after another) and correction factors of the first ``USED`` rotations."""
    n, dim = units.shape
    turns = rotations(dim, rotations_needed(dim, bits, tables))
    turned = units @ turns.reshape(-1, dim).T
    factors = np.abs(turned.reshape(n, -1, dim)[:, :USED]).sum(2) / math.sqrt(dim)
    return np.packbits(turned > 0, axis=1, bitorder="little"), factors.astype(np.float32)


def signs(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes, axis=1, bitorder="little")


def table_keys(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each code (row) and table (column): the table's number and its bits."""
    cut = signs(codes)[:, : bits * tables].reshape(len(codes), tables, bits)
    return (np.arange(tables, dtype=np.int64) << bits) | (cut.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)))


def estimates(codes: np.ndarray, factors: np.ndarray, dim: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of ``left`` x ``right``, and what a cosine of ``threshold`` may be off by at most."""
    used = factors.shape[1]
    plain = signs(codes)[:, : used * dim].reshape(len(codes), used, dim).astype(np.float32) * 2 - 1
    plain /= factors[:, :, None] * math.sqrt(dim)
    whole = sum(plain[:, k] @ turn for k, turn in enumerate(rotations(dim, used).astype(np.float32)))
    plain = plain.reshape(len(codes), -1)
    found = (whole[left] @ whole[right].T - plain[left] @ plain[right].T) / (used * (used - 1))
    error = (1 / factors.astype(float) ** 2 - 1).mean(1)  # squared length
    a, b = error[left][:, None], error[right][None, :]
    spread = 2 * ((a + b) * (1 - threshold**2) / used + a * b / (used * (used - 1))) / max(1, dim - 1)
    return found, SURE * np.sqrt(spread)


def candidates(codes: np.ndarray, factors: np.ndarray, keys: np.ndarray, table: int, dim: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left index, right index) to recompute, among those that meet in ``table`` first."""
    found, bound = estimates(codes, factors, dim, left, right, threshold)
    i, j = np.nonzero(found + bound >= threshold - 1e-4)  # room for the order of sums
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    for t in range(table):
        fresh = keys[i, t] != keys[j, t]
        i, j = i[fresh], j[fresh]
    return i, j


def exact_links(units: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    linked = np.zeros(len(i), bool)
    for lo in range(0, len(i), 100_000):
        s = slice(lo, lo + 100_000)
        linked[s] = np.einsum("ij,ij->i", units[i[s]], units[j[s]]) >= threshold
    return linked


def _smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


GROUP = ["dim", "key", "lo", "hi"]


def _by_group(it: Iterator[pa.RecordBatch], work: Callable[[tuple, list[tuple]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with each group of rows that lie together (first columns: GROUP) and yields the rows it returns."""
    held: list[tuple] = []
    out: list[tuple] = []
    now = None

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in it:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:4] != now:
                if len(held) > 1:
                    out += work(now, held)
                now, held = row[:4], []
            held.append(row[4:])
        if len(out) > 10_000:
            yield flushed()
    if len(held) > 1:
        out += work(now, held)
    yield flushed()


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            units = [None if u is None else u.tobytes() for u in unit_vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], ["vec_id", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(digest, "vec_id long, unit binary")
    rows = durable(rows.withColumn("of", F.unhex(F.md5("unit"))))
    alike = rows.where("of IS NOT NULL").groupBy("of").agg(F.min("unit").alias("unit"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("id"))
    classes = durable(alike.withColumn("uid", F.monotonically_increasing_id()))
    bits, tables = shape_of_tables(classes.count(), threshold, recall)

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = [x.as_py() for x in batch.column(1)]
            for size in sorted({len(x) for x in raw}):
                some = [k for k, x in enumerate(raw) if len(x) == size]
                codes, factors = encode(np.frombuffer(b"".join([raw[k] for k in some])).reshape(len(some), -1), bits, tables)
                keys = table_keys(codes, bits, tables)
                part = batch.take(pa.array(some))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                packed = [c.tobytes() + f.tobytes() for c, f in zip(codes, factors, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary()), listed], [*batch.schema.names, "code", "keys"])

    coded = durable(classes.select("uid", "unit").mapInArrow(code, "uid long, unit binary, code binary, keys array<long>"))
    spread = coded.select("uid", "code", F.expr("cast(length(unit) div 8 AS int)").alias("dim"), F.explode("keys").alias("key"))
    crowded = spread.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = durable(crowded.select(F.col("dim").alias("c_dim"), F.col("key").alias("c_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    few = crowded.count() <= SMALL
    spread = spread.join(F.broadcast(crowded) if few else crowded, F.expr("dim = c_dim AND key = c_key"), "left").drop("c_dim", "c_key")
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("blocks"))).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = spread.select("dim", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "uid", "code")
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "uid")

    def pairs(group: tuple, own: list[int], packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        dim, key, lo, hi = group
        size = -(-rotations_needed(dim, bits, tables) * dim // 8)
        both = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        codes, factors = both[:, :size], np.ascontiguousarray(both[:, size:]).view(np.float32)
        owner = np.array(own)
        left = np.flatnonzero(owner == lo)
        right = left if lo == hi else np.flatnonzero(owner == hi)
        return candidates(codes, factors, table_keys(codes, bits, tables), key >> bits, dim, left, right, threshold)

    def estimate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(group: tuple, held: list[tuple]) -> list[tuple]:
            own, uid, packed = zip(*held, strict=True)
            i, j = pairs(group, own, packed)
            return [(*group, own[k], uid[k]) for k in np.union1d(i, j).tolist()]

        schema = pa.schema([("dim", pa.int32()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.int32()), ("uid", pa.int64())])
        yield from _by_group(it, work, schema)

    asked = durable(dealt.mapInArrow(estimate, "dim int, key long, lo int, hi int, own int, uid long"))
    held = classes.select(F.col("uid").alias("c_uid"), "weight").join(coded.select("uid", "unit", "code"), F.expr("c_uid = uid")).drop("uid")
    fetched = asked.join(held, F.expr("uid = c_uid")).select(*GROUP, "own", "uid", "code", "unit", "weight")
    fetched = fetched.repartition(*GROUP).sortWithinPartitions(*GROUP, "uid")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(group: tuple, held: list[tuple]) -> list[tuple]:
            own, uid, packed, units, weight = zip(*held, strict=True)
            i, j = pairs(group, own, packed)
            linked = exact_links(np.frombuffer(b"".join(units)).reshape(len(held), -1), i, j, threshold)
            i, j, w = i[linked], j[linked], np.array(weight, np.int64)
            links = np.bincount(i, w[j], len(held)) + np.bincount(j, w[i], len(held))
            roots = _smallest_reachable(len(held), i, j)
            return [(uid[k], int(links[k]), uid[int(roots[k])]) for k in np.flatnonzero(links).tolist()]

        yield from _by_group(it, work, pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    found = durable(fetched.mapInArrow(compare, "uid long, n long, root long"))
    for done in (asked, crowded, coded):
        discard(done)
    links = found.groupBy(F.col("uid").alias("l_uid")).agg(F.sum("n").alias("n"))
    reach = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    known = classes.select("uid", "of", "weight", "id").join(links, F.expr("uid = l_uid"), "left").join(reach, F.expr("uid = node"), "left")
    known = durable(known.select(F.col("of").alias("k_of"), "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "uid").alias("label")))
    least = known.groupBy(F.col("label").alias("r_label")).agg(F.min("id").alias("reached"))
    known = known.join(least, F.expr("label = r_label")).select("k_of", "n_links", "reached")
    out = rows.join(known, F.col("of") == F.col("k_of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("reached"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
