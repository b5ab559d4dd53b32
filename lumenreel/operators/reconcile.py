"""Reconciliation of two bags of lines: normalise, first occurrences, fuzzy anti-joins, multiset differences, a report.

Lines are rows (container, line_no, text) of either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import common_many, normalise_line, score_bound, token_set_score, tokens


def lines_of(df: DataFrame, container: str, text: str, least: int = 3) -> DataFrame:
    """container, line_no, text: the normalised lines of a column that have at least ``least`` characters."""
    # normalised before they become rows: the filter by length would otherwise do it again
    rows = df.select(F.col(container).alias("container"), F.posexplode(F.transform(F.split(text, "\n", -1), normalise_line)).alias("line_no", "text"))
    rows = rows.select("container", F.col("line_no").cast("long").alias("line_no"), "text")
    return rows.where(F.length("text") >= least)


def first_lines(lines: DataFrame) -> DataFrame:
    """Distinct texts with their first occurrence: text, container, line_no, occurrences."""
    return lines.groupBy("text").agg(F.min(F.struct("container", "line_no")).alias("f"), F.count(F.lit(1)).alias("occurrences")).select("text", "f.container", "f.line_no", "occurrences")


def missing_exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct texts of ``left`` that ``right`` hasn't."""
    return left.select("text").distinct().join(right.select("text").distinct(), "text", "left_anti")


#: Texts that look for a match at once: their number, not the other side's, bounds what a task holds.
QUERIES = 5_000


def best_matches(left: DataFrame, right: DataFrame, enough: int = 101, least: int = 0) -> DataFrame:
    """Each distinct text of ``left`` with the best token-set score among ``right``'s texts: text, best, best_text (null: none).

    Equal texts match by an equi-join.  The rest is a set of queries against all rows: at most ``QUERIES`` of them at a time go
    to every task, which scans its part of the other side and keeps one best row per query; a pair is scored in full only if
    the bound that follows from word lengths beats the best so far.  ``enough``: a query that has reached so much looks no
    further, its best is then at least that.  Of equal scores the shorter text wins, then the first in order.
    If the other side is the smaller one, its texts go to every task instead, and each query meets them where it is.
    ``least``: pairs that can't reach so much are not scored; a best below it may then be too low.
    """
    ours, theirs = left.select("text").distinct(), right.select("text").distinct()
    out = ours.join(theirs, "text", "left_semi").select("text", F.lit(100).alias("best"), F.col("text").alias("best_text"))
    rest = ours.join(theirs, "text", "left_anti")
    # scoring is the work here, not reading: short lines are spread over all cores
    cores = max(2, theirs.sparkSession.sparkContext.defaultParallelism)
    asking, offered = rest.count(), theirs.count()
    if asking > offered:
        return out.unionByName(_best_of_few(rest, theirs, -(-offered // QUERIES), cores, enough, least))
    blocks = -(-asking // QUERIES)
    scanned = theirs.repartition(cores)
    for k in range(blocks):
        some = rest.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        asked = theirs.sparkSession.sparkContext.broadcast(sorted(r.text for r in some.collect()))
        found = scanned.mapInArrow(_scan(asked, enough, least), "text string, best int, other string")
        found = found.groupBy("text").agg(F.min(F.struct((-F.col("best")).alias("k"), F.length("other").alias("n"), "other")).alias("m"))
        found = found.select("text", (-F.col("m.k")).alias("best"), F.col("m.other").alias("best_text"))
        out = out.unionByName(some.join(found, "text", "left").select("text", F.coalesce("best", F.lit(0)).alias("best"), "best_text"))
    return out


def _best_of_few(rest: DataFrame, theirs: DataFrame, blocks: int, cores: int, enough: int, least: int) -> DataFrame:
    """Best matches of ``rest`` among a side that is the smaller one: a row per query and block of that side."""
    rows, found = rest.repartition(cores), None
    for k in range(blocks):
        some = theirs.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        offered = theirs.sparkSession.sparkContext.broadcast(sorted((r.text for r in some.collect()), key=lambda t: (len(t), t)))
        best = rows.mapInArrow(_choose(offered, enough, least), "text string, best int, other string")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return rest.select("text", F.lit(0).alias("best"), F.lit(None).cast("string").alias("best_text"))
    if blocks > 1:
        found = found.groupBy("text").agg(F.min(F.struct((-F.col("best")).alias("k"), F.length("other").alias("n"), "other")).alias("m"))
        found = found.select("text", (-F.col("m.k")).alias("best"), F.col("m.other").alias("other"))
    return found.select("text", F.coalesce("best", F.lit(0)).alias("best"), F.col("other").alias("best_text"))


def _choose(offered, enough: int, least: int):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = offered.value  # in the order that decides between equal scores
        words = [frozenset(t.split()) for t in texts]
        for batch in batches:
            asked = batch.column(0).to_pylist()
            scores: list[int | None] = []
            others: list[str | None] = []
            for text in asked:
                mine, best, at = frozenset(text.split()), least - 1, None
                for k, theirs in enumerate(words):
                    if best >= enough:
                        break
                    if score_bound(mine, theirs) > best and (score := token_set_score(text, texts[k])) > best:
                        best, at = score, texts[k]
                scores.append(None if at is None else best)
                others.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.int32()), pa.array(others, pa.string())], ["text", "best", "other"])

    return choose


def _scan(asked, enough: int, least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = asked.value
        words = [frozenset(t.split()) for t in texts]
        best: list[tuple[int, int, str] | None] = [None] * len(texts)
        for batch in batches:
            for other in batch.column(0).to_pylist():
                theirs = frozenset(other.split())
                for k, mine in enumerate(words):
                    now = best[k]
                    if now is not None and now[0] <= -enough or score_bound(mine, theirs) < (least if now is None else max(least, -now[0])):
                        continue
                    row = (-token_set_score(texts[k], other), len(other), other)
                    if now is None or row < now:
                        best[k] = row
        rows = [(t, -b[0], b[2]) for t, b in zip(texts, best, strict=True) if b is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["text", "best", "other"])

    return scan


#: Cells that a line's characters are counted in, by code point: a first and a second look.  Counts end at ``MOST``.
COARSE, FINE, MOST = 16, 64, 16_000
#: Lines that are taken at once, and pairs of lines that one step holds.
STEP, PAIRS = 4_096, 200_000


def matched(left: DataFrame, right: DataFrame, limit: int = 85) -> DataFrame:
    """The distinct texts of both sides that score ``limit`` (1 to 100) or more with some text of the other: side (0: left), text.

    The smaller side goes to every task, at most ``QUERIES`` texts at a time, the other is read where it is; one pass serves both
    sides.  Every pair is decided: what the two sets of words share settles the two comparisons with the common words, from an
    inverted index; the third can't reach the limit if the characters differ too much in number, cell by cell, and is computed otherwise.
    """
    ours, theirs = left.select("text").distinct(), right.select("text").distinct()
    few = [r.text for r in theirs.limit(QUERIES + 1).collect()]
    many, side, blocks = ours, 0, [few] if few else []
    if len(few) > QUERIES:
        asking, offered = ours.count(), theirs.count()
        many, small, side = (theirs, ours, 1) if asking < offered else (ours, theirs, 0)
        n = -(-min(asking, offered) // QUERIES)
        blocks = ([r.text for r in small.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()] for k in range(n))
    out = many.where("false").select(F.lit(0).alias("side"), "text")
    for block in blocks:
        shared = many.sparkSession.sparkContext.broadcast(block)
        out = out.unionByName(many.mapInArrow(_match(shared, side, limit), "side int, text string"))
    return out.distinct()


def _char_counts(joined: list[str], length: np.ndarray) -> np.ndarray:
    """A row per text: its characters by cell."""
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(joined)), length)
    return np.minimum(np.bincount(row * FINE + points % FINE, minlength=len(joined) * FINE), MOST).reshape(-1, FINE).astype(np.int16)


def _coarse(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts.reshape(len(counts), FINE // COARSE, COARSE).sum(1, dtype=np.int32), MOST).astype(np.int16)


def _match(few, side: int, limit: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: set(t.split()) for t in few.value if t is not None}
        bare = {t for t, w in held.items() if not w}  # without a word: alike only if equal
        texts = sorted(held.keys() - bare, key=lambda t: (sum(map(len, held[t])) + len(held[t]), t))
        joined = [" ".join(held[t]) for t in texts]
        size = np.array([len(j) for j in joined], np.int64)
        fine = _char_counts(joined, size)
        coarse = _coarse(fine)
        index: dict[str, list[int]] = {}
        for k, t in enumerate(texts):
            for w in held[t]:
                index.setdefault(w, []).append(k)
        number = {w: k for k, w in enumerate(index)}
        occurs = np.array([len(v) for v in index.values()], np.int64)
        first = np.cumsum(occurs) - occurs
        posting = np.array([k for v in index.values() for k in v], np.int64)
        weight = np.array([len(w) + 1 for w in index], np.float64)
        found = np.zeros(len(texts), bool)

        def settle(some: list, words: list[set[str]], long: np.ndarray, hit: np.ndarray) -> None:
            for x, y in some and [map(np.concatenate, zip(*some, strict=True))]:
                go = ~(hit[x] & found[y])
                x, y = x[go], y[go]
                near = _near([words[k] for k in x], [held[texts[k]] for k in y], long[x] + size[y], limit)
                hit[x[near]] = True
                found[y[near]] = True

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = [t for t in batch.column(0).slice(at, STEP).to_pylist() if t is not None]
                yield _rows(side, [t for t in rows if t in bare])
                yield _rows(1 - side, [t for t in rows if t in bare])
                words = [set(t.split()) for t in rows]
                long = np.array([sum(map(len, w)) + len(w) - 1 for w in words], np.int64)
                order = np.argsort(long, kind="stable")[np.count_nonzero(long < 0) :]
                hit = np.zeros(len(rows), bool)
                maybe, waiting = [], 0
                for part in np.array_split(order, max(1, -(-len(order) * len(texts) // PAIRS))) if len(texts) else []:
                    if not len(part):
                        continue
                    # what the words share; with a word's length and one more, the sum is that of the joined words and one more
                    known = [[k for w in words[i] if (k := number.get(w)) is not None] for i in part]
                    ids = np.array([k for some in known for k in some], np.int64)
                    times = occurs[ids]
                    line = np.repeat(np.repeat(np.arange(len(part)), [len(some) for some in known]), times)
                    place = np.repeat(first[ids] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    both = np.bincount(line * len(texts) + posting[place], np.repeat(weight[ids], times), len(part) * len(texts))
                    cells = np.flatnonzero(both)
                    i, k = np.divmod(cells, len(texts))
                    sect, least = both[cells] - 1, np.minimum(long[part][i], size[k])
                    sure = 100 - 100 * (least - sect) / (sect + least) >= limit
                    hit[part[i[sure]]] = True
                    found[k[sure]] = True
                    # whole sets of words: texts of lengths too far apart are out at once
                    low = np.searchsorted(size, long[part[0]] * limit / (200 - limit) - 1)
                    high = np.searchsorted(size, long[part[-1]] * (200 - limit) / limit + 1, "right")
                    if low >= high or hit[part].all() and found[low:high].all():
                        continue
                    mine = _char_counts([" ".join(words[i]) for i in part], long[part])
                    sums = long[part][:, None] + size[None, low:high]
                    apart = np.abs(_coarse(mine)[:, None, :] - coarse[None, low:high]).sum(2, dtype=np.int32)
                    open_ = (100 - 100 * apart / sums >= limit) & ~(hit[part][:, None] & found[None, low:high])
                    i, k = np.nonzero(open_)
                    for of in range(0, len(i), PAIRS // 10):
                        a, b = i[of : of + PAIRS // 10], k[of : of + PAIRS // 10] + low
                        edits = np.abs(mine[a] - fine[b]).sum(1, dtype=np.int32)
                        near = 100 - 100 * edits / (long[part][a] + size[b]) >= limit
                        a, b = a[near], b[near]
                        maybe.append((part[a], b))
                        waiting += len(a)
                        if waiting >= PAIRS // 10:
                            settle(maybe, words, long, hit)
                            maybe, waiting = [], 0
                settle(maybe, words, long, hit)
                yield _rows(side, [rows[k] for k in np.flatnonzero(hit)])
        yield _rows(1 - side, [texts[k] for k in np.flatnonzero(found)])

    return match


def _near(ones: list[set[str]], twos: list[set[str]], sums: np.ndarray, limit: int) -> np.ndarray:
    """Whether the own words of either set are near enough, with what they share before them (lengths of both: ``sums``)."""
    xs, ys = [" ".join(sorted(b - a)) for a, b in zip(ones, twos, strict=True)], [" ".join(sorted(a - b)) for a, b in zip(ones, twos, strict=True)]
    both = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)], np.int64)
    common = np.zeros(len(xs), np.int64)
    order = np.array(sorted(range(len(xs)), key=lambda k: len(xs[k])), np.int64)
    need = np.floor((both - (100 - limit) * sums / 100) / 2).astype(np.int64)
    # tables of bits by pair and letter: fewer pairs at a time if they are long
    while len(order):
        some = order[: max(1, min(4_096, 1_000_000 // (len(xs[order[min(len(order), 4_096) - 1]]) + 64)))]
        common[some] = common_many([xs[k] for k in some], [ys[k] for k in some], need[some])
        order = order[len(some) :]
    return 100 - 100 * (both - 2 * common) / sums >= limit


def _rows(side: int, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["side", "text"])


def missing_fuzzy(left: DataFrame, right: DataFrame, limit: int = 85) -> DataFrame:
    """Fuzzy left anti-join: the texts of ``left`` whose best score is below ``limit``."""
    return best_matches(left, right, enough=limit).where(F.col("best") < limit)


def duplicates(lines: DataFrame, least: int = 8) -> DataFrame:
    """Texts of at least ``least`` characters that occur more than once: text, n."""
    return lines.where(F.length("text") >= least).groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_counts(df: DataFrame, text: str, least: int = 4) -> DataFrame:
    """The multiset of tokens of a column: token, n."""
    return df.select(F.explode(tokens(F.col(text), least)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "token", "left_anti")


def over_repeated(source: DataFrame, stitched: DataFrame, least: int = 3, times: int = 2) -> DataFrame:
    """Tokens that occur ``least`` times or more, and ``times`` as often as in the source: token, n_source, n_stitched."""
    joined = stitched.select("token", F.col("n").alias("n_stitched")).join(source.select("token", F.col("n").alias("n_source")), "token", "left")
    joined = joined.withColumn("n_source", F.coalesce("n_source", F.lit(0)).cast("long"))
    return joined.where((F.col("n_stitched") >= least) & (F.col("n_stitched") >= times * F.greatest(F.lit(1), F.col("n_source"))))


def share(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(F.lit(1), whole), 2)


def report(left: DataFrame, right: DataFrame, exact: bool = False, limit: int = 85) -> DataFrame:
    """One row: distinct lines of either side, those without a match, recall and precision in per cent."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(left.select("text").distinct(), "n_source"), count(right.select("text").distinct(), "n_stitched")]
    if exact:
        parts += [count(missing_exact(left, right), "missing"), count(missing_exact(right, left), "unmatched")]
    else:  # only whether a line reaches the limit counts, not its score
        parts.append(matched(left, right, limit).agg(F.count_if(F.col("side") == 0).alias("missing"), F.count_if(F.col("side") == 1).alias("unmatched")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    if not exact:
        out = out.withColumns({"missing": F.col("n_source") - F.col("missing"), "unmatched": F.col("n_stitched") - F.col("unmatched")})
    out = out.withColumn("recall", share(F.col("n_source") - F.col("missing"), F.col("n_source")))
    return out.withColumn("precision", share(F.col("n_stitched") - F.col("unmatched"), F.col("n_stitched")))


def vocabulary_report(source: DataFrame, stitched: DataFrame) -> DataFrame:
    """One row: sizes of both vocabularies and of what they share, recall and precision in per cent."""
    both = source.select("token", F.lit(1).alias("s")).join(stitched.select("token", F.lit(1).alias("t")), "token", "full")
    out = both.agg(F.count("s").alias("n_source"), F.count("t").alias("n_stitched"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("shared"))
    return out.withColumn("recall", share(F.col("shared"), F.col("n_source"))).withColumn("precision", share(F.col("shared"), F.col("n_stitched")))
