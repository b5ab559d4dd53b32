"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text.  Parsing a text with it greedily into
the longest stretches that occur in the sample gives a number of phrases; phrases times the bits that name one (where in
the sample, and how long), per character, estimate the text's cross entropy, and the language with the smallest wins.  A
letter that the sample hasn't is a phrase that costs ``UNKNOWN_BITS`` at least, so that a sample of a few letters, cheap to
point into, can't win texts by not knowing them.

Since each phrase starts at the automaton's initial state, the parse is a walk of a complete transition table: where a
state has no edge, the walk goes on from the initial state's edge and counts a phrase.  Texts are cut into segments of
``SEGMENT`` characters that are walked side by side, one numpy step per character position (a cut may add one phrase to
each language's count, so it favours none).

Sample (the documented bound): per language, of the eligible rows by hash of doc_id, up to ``SAMPLE_DOCS`` documents,
whole ones, until ``SAMPLE_CHARS`` characters (or an equal part of ``ALL_CHARS``, if there are very many languages); a
document that would go past it is cut there; of a script of many letters less is taken, so that the transition table
keeps within ``CELLS``, but every letter of a sample is told apart.  Every prediction reads its whole text.

Results for odd input
    null text or no letter: ``und``, score 0.  No labelled row: every prediction is ``und``.  Equal counts: the language
    first by code point.  null doc_id: predicted, never learned from, held_out false.  Repeated rows: one result each.
    Very long text: linear work.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import crc_mod

SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 64, 24_000, 1_000_000
#: Cells of a language's transition table, and of all tables together.
CELLS, ALL_CELLS = 8_000_000, 64_000_000
#: Bits for a phrase's length, and the least that a letter costs that the sample hasn't.
LENGTH_BITS, UNKNOWN_BITS = 4.0, 24.0
SEGMENT = 256
#: Characters walked at once.
BATCH = 2_000_000
OTHER, PAD, GAP = 0, 1, 2
UNDETERMINED = "und"


class SuffixAutomaton:
    """Of a sequence of small integers: the smallest automaton of its substrings, one edge dictionary per state."""

    def __init__(self, symbols: list[int]) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            now = self._state(self.length[last] + 1, {}, -1)
            p = last
            while p >= 0 and c not in self.edges[p]:
                self.edges[p][c] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.edges[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = self._state(self.length[p] + 1, dict(self.edges[q]), self.link[q])
                    while p >= 0 and self.edges[p].get(c) == q:
                        self.edges[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.edges) - 1


def letters() -> np.ndarray:
    """Per code point: the code point of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, other stretches as one 0, and the texts' starts in them (with the end)."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    lows = lower[points]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    keep = (lows != 0) | np.concatenate([[True], lows[:-1] != 0])
    return lows[keep], np.concatenate([[0], np.cumsum(keep)[ends - 1]])


class Model:
    """Transition tables of all languages and the code points that they tell apart."""

    def __init__(self, samples: dict[str, list[str]], lower: np.ndarray) -> None:
        self.lower = lower
        self.languages = sorted(samples)
        each = min(SAMPLE_CHARS, ALL_CHARS // max(1, len(samples)))
        cells = min(CELLS, ALL_CELLS // max(1, len(samples)))
        self.classes, self.tables, self.costs = [], [], []
        for name in self.languages:
            text = normalised(samples[name], lower)[0][:each]
            new = np.zeros(len(text), bool)
            new[np.unique(text, return_index=True)[1]] = True
            # at most two states a character, a cell for each letter so far
            text = text[: max(1, int(np.searchsorted(2 * np.arange(1, len(text) + 1) * (np.cumsum(new) + GAP + 1), cells, side="right")))]
            points = np.unique(text[text > 0])
            classes = np.zeros(0x110000, np.uint8 if len(points) < 250 else np.uint16)
            classes[0] = GAP
            classes[points] = np.arange(len(points)) + GAP + 1
            width = len(points) + GAP + 1
            edges = SuffixAutomaton(classes[text].tolist()).edges
            table = np.full((len(edges), width), -1, np.int32)
            for s, out in enumerate(edges):
                if out:
                    table[s, list(out)] = list(out.values())
            table[:, OTHER] = -1
            first = np.where(table[0] >= 0, table[0], 0)
            walk = np.where(table >= 0, table, first)
            broken = (table < 0).astype(np.int32)
            broken[0] = 0  # a phrase that has just begun
            # an unknown character is a phrase, and ends the one before unless that has just begun
            broken[:, OTHER] = 2
            broken[0, OTHER] = 1
            packed = walk.astype(np.int32) * width * 4 + broken
            packed[:, PAD] = np.arange(len(edges)) * width * 4
            self.classes.append(classes)
            self.tables.append(packed.ravel())
            self.costs.append(math.log2(max(2, len(text))) + LENGTH_BITS)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        return self._walk(symbols, starts)[0]

    def _walk(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and letters that the language's sample hasn't, of each text (rows) in each language (columns)."""
        n = len(starts) - 1
        lengths = np.diff(starts)
        pieces = np.maximum(1, -(-lengths // SEGMENT))
        owner = np.repeat(np.arange(n), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + place * SEGMENT
        size = np.minimum(SEGMENT, starts[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        out, unknown = np.zeros((2, n, len(self.languages)))
        padded = np.concatenate([symbols, np.zeros(SEGMENT, symbols.dtype)])
        active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than t
        for k, (classes, table) in enumerate(zip(self.classes, self.tables, strict=True)):
            coded = classes[padded]
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for t in range(SEGMENT):
                m = active[t]
                if not m:
                    break
                now = table[state[:m] + coded[begin[:m] + t]]
                count[:m] += now & 3
                state[:m] = now >> 2
            out[:, k] = np.bincount(owner, count + (size > 0), n)
            unknown[:, k] = np.diff(np.concatenate([[0], np.cumsum(coded[: len(symbols)] == OTHER)])[starts])
        return out, unknown

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (share of the winner among the languages, by cross entropy) of each whole text."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end] or "") <= BATCH):
                held += len(texts[end] or "")
                end += 1
            symbols, starts = normalised([t or "" for t in texts[at:end]], self.lower)
            some = np.diff(np.concatenate([[0], np.cumsum(symbols > 0)])[starts])
            if self.languages:
                phrases, unknown = self._walk(symbols, starts)
                cost = phrases * np.array(self.costs) + unknown * np.maximum(0, UNKNOWN_BITS - np.array(self.costs))
                for k in np.flatnonzero(some).tolist():
                    per = cost[k] / max(1, starts[k + 1] - starts[k])
                    best = int(np.argmin(per))
                    names[at + k] = self.languages[best]
                    odds = np.exp2(np.clip((per[best] - per) * min(64, starts[k + 1] - starts[k]), -60, 0))
                    scores[at + k] = float(1 / odds.sum())
            at = end
        return names, scores


def sample(docs: DataFrame, learn: str) -> dict[str, list[str]]:
    """Texts to learn each language from; ``learn``: the condition that eligible rows meet."""
    rows = docs.where(learn).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("k"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h", "k"))).where(f"place <= {SAMPLE_DOCS}")
    ids = [r.k for r in first.select("k").distinct().collect()]  # SAMPLE_DOCS per language
    texts: dict[str, list[tuple[int, str]]] = {}
    found = docs.where(learn).where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    for r in found.select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS * 2).alias("text")).dropDuplicates().collect():
        texts.setdefault(r.lang, []).append((r.doc_id, r.text))
    return {lang: [t for _, t in sorted(held)] for lang, held in texts.items()}


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.  Learns from rows whose crc32(doc_id) mod ``modulus`` isn't ``held``."""
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("crc", crc_mod("doc_id", modulus))
    samples = sample(part, f"crc != {held}")
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most ALL_CHARS characters or so

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, letters())
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                names, scores = model.predict(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = part.select("doc_id", F.coalesce(F.col("crc") == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")
