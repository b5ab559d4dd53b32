"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks; DataFrame operations only.

Sources, by code point (null last), weigh 1, 2, 3, 1, 2, 3 and so on and share 100 % of all words; a target stops at three
times its source's size and the excess is shared again by weight until none is above.  That end state is a common
level ``w * lambda`` below the caps, found in one pass over the sources sorted by cap per weight.

Targets become whole blocks by highest quotients (votes / (2 * seats + 1)), and a source's blocks go to its seeded
shards the same way, with the shards' sizes as votes.  Within a shard documents lie in seeded order; its quota is some
whole rounds and the first blocks of that order.  The block length is one for all sources, short enough that rounding
moves no source's mix by more than about half a per cent.  A source has about half the square root of its rows as shards,
so a source with a third of all rows is spread, and no task holds more than the root of it.

Results for odd input
    null or empty text: size 0, nothing is taken.  null source: a source of its own.  null doc_id: a row like any other.
    Repeated rows: each counts.  No words at all: every target is 0.  Empty table: no rows.  Other columns: ignored by
    :func:`mix`, kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import WORD, durable, fresh

WEIGHTS, COPIES, SEED = (1, 2, 3), 3, 17
LONGEST_BLOCK = 1024


def targets(sources: DataFrame) -> DataFrame:
    """Of sources (source, source_size, ...): adds weight and target (double), in words."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    at = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1
    known = sources.withColumn("weight", F.element_at(weights, at).cast("double"))
    cap = F.lit(COPIES) * F.col("source_size").cast("double")
    known = known.withColumn("cap", cap).withColumn("bound", F.col("cap") / F.col("weight"))
    order = W.orderBy("bound", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = known.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    known = known.withColumn("capped", level > F.col("bound"))
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    share = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - held) / share)
    return known.withColumn("target", target).drop("cap", "bound", "capped")


def apportion(items: DataFrame, group: list[str], item: list[str], votes: str, house: str) -> DataFrame:
    """Sainte-Laguë: adds ``seats`` to ``items``; per group they sum to ``house`` (a column equal within the group).

    Rounding votes / (all votes / house) gives all but a few seats; those go to the highest quotients that are still
    open, or come from the lowest that were given.
    """
    by = W.partitionBy(*group) if group else W.partitionBy()
    whole = F.sum(votes).over(by)
    base = F.when(whole > 0, F.floor(F.col(votes) * F.col(house) / whole + 0.5)).otherwise(0).cast("long")
    rows = items.withColumn("base", base).withColumn("short", F.col(house).cast("long") - F.sum("base").over(by)).withColumn("whole", whole)
    # at a divisor that seats all, those that have seats can't have moved by more than this
    big = F.sum(F.when(F.col("base") > 0, F.col(votes)).otherwise(0)).over(by)
    bigs = F.sum(F.when(F.col("base") > 0, 1).otherwise(0)).over(by)
    rows = rows.withColumn("big", big).withColumn("bigs", bigs)
    moves = F.ceil((F.abs("short") + F.col("bigs")) * F.col(votes) / F.greatest(F.col("big"), F.lit(1e-300))) + 2
    near = F.when(F.col("big") > 0, F.least(F.abs("short"), moves.cast("long"))).otherwise(F.abs("short"))
    steps = F.when((F.col("short") == 0) | (F.col("whole") == 0), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.when(F.col("short") < 0, F.least(near, F.greatest(F.col("base"), F.lit(1)))).otherwise(near) - 1)
    )
    open_ = rows.withColumn("step", F.explode(steps))
    up, down = F.col(votes) / (2 * (F.col("base") + F.col("step")) + 1), F.col(votes) / (2 * (F.col("base") - F.col("step")) - 1)
    open_ = open_.withColumn("quotient", F.when(F.col("short") > 0, -up).when(F.col("base") > F.col("step"), down).otherwise(F.lit(float("inf"))))
    place = F.row_number().over(by.orderBy("quotient", *[F.col(c).asc_nulls_last() for c in item], "step"))
    moved = F.when(place <= F.abs("short"), F.signum("short").cast("long")).otherwise(0)
    seated = open_.withColumn("moved", moved).groupBy(*group, *item, "base").agg(F.sum("moved").alias("moved"))
    keys = [*group, *item]
    seated = seated.select(*[F.col(c).alias(f"k_{c}") for c in keys], (F.col("base") + F.col("moved")).alias("seats"))
    on = [items[c].eqNullSafe(seated[f"k_{c}"]) for c in keys]
    return items.join(seated, on).drop(*[f"k_{c}" for c in keys])


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("text").alias("th"), *more)


def _plan(sized: DataFrame, seed: int) -> DataFrame:
    """Rows of ``sized`` (durable) with source_size, target and taken."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = targets(sources).withColumn("shards", F.ceil(F.sqrt("n") / 2).cast("long"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fine = F.min(F.when(F.col("target") > 0, F.col("target") / (200 * F.col("shards")))).over(everything)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(LONGEST_BLOCK), F.floor(F.coalesce(fine, F.lit(1.0))))).cast("long"))
    sources = sources.withColumn("house", F.floor(F.col("total") / F.col("block") + 0.5))
    sources = durable(apportion(sources, [], ["source"], "target", "house").select("source", "source_size", "target", "shards", "block", F.col("seats").alias("blocks")))
    named = sources.withColumnRenamed("source", "s_source")
    seeded = F.coalesce("doc_id", "th")  # rows without doc_id don't all go to one shard
    shard = F.pmod(F.xxhash64(seeded, F.lit(seed)), F.col("shards"))
    rows = sized.join(named, sized.source.eqNullSafe(named.s_source)).drop("s_source").withColumn("shard", shard)
    held = rows.groupBy("source", "shard", "block", "blocks").agg(F.sum("size").alias("words"))
    quotas = apportion(held, ["source"], ["shard"], "words", "blocks")
    quotas = quotas.select(
        F.col("source").alias("q_source"),
        F.col("shard").alias("q_shard"),
        "words",
        F.least(F.col("seats") * F.col("block"), COPIES * F.col("words")).alias("quota"),
    )
    rows = rows.join(quotas, rows.source.eqNullSafe(quotas.q_source) & (rows.shard == quotas.q_shard))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(seeded, F.lit(seed + 1)), "doc_id", "size", "th").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum("size").over(order) - F.col("size")
    rounds = F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("rounds") * F.col("words") - F.col("start")))
    return rows.withColumn("rounds", rounds).withColumn("start", start).withColumn("taken", (F.col("rounds") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, source."""
    return _plan(durable(_sizes(docs)), seed).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document as often as it is taken whole, and, where the mix
    takes only its first words, once with the text cut after them."""
    row, = fresh(docs, "mix_row")
    marked = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = _plan(durable(_sizes(marked, F.col(row))), seed).where("taken > 0").select(F.col(row).alias(f"{row}_t"), "size", "taken")
    size, count, copy = fresh(marked, "mix_size", "mix_taken", "mix_copy")
    taken = taken.withColumnsRenamed({"size": size, "taken": count})
    out = marked.join(taken, F.col(row) == F.col(f"{row}_t"))
    copies = F.expr(f"explode(sequence(0, cast(ceil({count} / {size}) AS int) - 1))").alias(copy)
    out = out.select("*", copies)
    rest = F.col(count) - F.col(copy) * F.col(size)
    words = F.regexp_extract_all("text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(rest, F.lit(0)).cast("int")), "")
    out = out.withColumn("text", F.when(rest >= F.col(size), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(rest >= F.col(size), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
