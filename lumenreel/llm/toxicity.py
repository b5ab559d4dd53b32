"""Toxicity scores: Levenshtein automata walked over a lexicon trie, and the hits' context windows.

Lexicon
    Learned from labelled rows: whole words and word stems (prefixes of ``STEM_LENGTHS`` letters) that occur in toxic
    documents and hardly in others, joined with ``SEED_TERMS``.  All entries lie in one trie.  A word hits if it equals
    a term, begins with a stem, or is misspelled: the trie of terms intersected with their Levenshtein automata accepts it
    within one edit (two from nine letters on).  Terms of fewer than ``SHORT`` letters and stems must be met exactly.  A
    misspelling counts only if the word as written is in no clean labelled document.  Look-alike digits and signs are read as letters first.

Context
    A hit is quoted if quotation marks enclose it within ``WINDOW`` words, or a word of reporting or rejection stands
    there; it then weighs as a separate, weaker feature.

Score
    A logistic model over six features of the document's hits.  Its weights start from a prior that already ranks the
    kinds of hits and are fitted to the labelled rows (penalised Newton steps); stems and misspellings share the weight
    of any hit and differ from it by a fitted part, so kinds that the labels don't show keep the prior's difference.

Bound of the sample (documented): the ``SAMPLE`` eligible labelled rows with the smallest hash of doc_id, whole texts, but
none of more than ``SAMPLE_CHARS`` characters, so that what the driver holds is bounded.
Every score reads its whole text.

Results for odd input
    null or empty text: no hits, the model's base score.  No labelled row: seed terms and prior.  null doc_id: scored,
    never learned from, held_out false.  Repeated rows: one result each.  Very long text: linear work.  Empty table: no
    rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import crc_mod

SAMPLE, SAMPLE_CHARS, MEMO = 3_000, 200_000, 200_000
#: Texts whose words are held at once.
STEP = 128
#: Letters of a term and a word from which two edits are one misspelling.
LONG = 9
#: Letters of the shortest term of which a word one edit away is a misspelling (of four letters every second word would be).
SHORT = 5
STEM_LENGTHS = (4, 5, 6)
WINDOW = 6
#: Common English terms of abuse, whatever the labels show.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "asshole", "bitch")
#: Words of reporting or rejection, in the languages at hand.
REPORTING = frozenset(
    "said says saying called calls quote quoted quotes wrote writes word term insult insulting slur reported alleged "
    "sagte sagt nannte zitat zitiert wort beleidigung dijo dice llamó cita palabra insulto dit disait appelé citation mot insulte".split()
)
QUOTES = "\"'“”„«»‘’‹›"
LOOK_ALIKE = str.maketrans("013457@$", "oieastas")
WORDS = re.compile(r"[^\W_]+(?:[@$*'’][^\W_]+)*")
#: Features: 1; any hit that isn't quoted and the log-count of further ones; whether all of these begin with a stem,
#: or all are misspelled; any quoted hit and the log-count of further ones.  Prior means and precisions of the weights.
PRIOR = np.array([-4.0, 6.0, 0.5, 0.0, -0.5, 1.0, 0.2])
PRECISION = np.array([0.05, 0.05, 0.2, 1.0, 2.0, 0.2, 0.2])


class LevenshteinTrie:
    """The intersection of a trie of terms with the automata of all words within ``edits`` edits, made deterministic.

    A state is the set of (trie node, edits spent) that a word so far can have reached; letters outside the terms share one
    symbol.  Words then run through a table, all at once.
    """

    def __init__(self, terms: list[str], edits: int) -> None:
        letters = sorted({c for t in terms for c in t})
        self.symbols = {ord(c): k + 1 for k, c in enumerate(letters)}
        children: list[dict[str, int]] = [{}]
        final = {0: False}
        for t in terms:
            node = 0
            for c in t:
                if c not in children[node]:
                    children[node][c] = len(children)
                    final[len(children)] = False
                    children.append({})
                node = children[node][c]
            final[node] = True

        def closed(found: dict[int, int]) -> frozenset:
            todo = list(found)
            while todo:  # a term's letter left out
                node = todo.pop()
                if found[node] < edits:
                    for child in children[node].values():
                        if found.get(child, edits + 1) > found[node] + 1:
                            found[child] = found[node] + 1
                            todo.append(child)
            return frozenset(found.items())

        states, rows, accept = {frozenset(): 0}, [[0] * (len(letters) + 1)], [False]
        todo = [closed({0: 0} if terms else {})]
        self.start = states.setdefault(todo[0], len(states))
        if self.start:
            rows.append([])
            accept.append(any(final[n] for n, _ in todo[0]))
        while todo:
            state = todo.pop()
            at = states[state]
            if not state:
                continue
            row = []
            for c in ["", *letters]:
                found: dict[int, int] = {}
                for node, spent in state:
                    for d, child in children[node].items():
                        cost = spent + (d != c)
                        if cost <= edits and found.get(child, edits + 1) > cost:
                            found[child] = cost
                    if spent < edits and found.get(node, edits + 1) > spent + 1:
                        found[node] = spent + 1  # a letter too many
                then = closed(found)
                if then not in states:
                    states[then] = len(states)
                    rows.append([])
                    accept.append(any(final[n] for n, _ in then))
                    todo.append(then)
                row.append(states[then])
            rows[at] = row
        self.table = np.array(rows, np.int32)
        self.accept = np.array(accept)
        self.letter = np.zeros(0x110000, np.uint8 if len(letters) < 255 else np.uint16)
        for c, k in self.symbols.items():
            self.letter[c] = k

    def accepts(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), bool)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), 8192):
            some = [words[k] for k in order[lo : lo + 8192]]
            width = len(some[-1])
            if not width:
                continue
            coded = self.letter[np.array(some, dtype=f"<U{width}").view("<u4").reshape(len(some), width)]
            size = np.fromiter(map(len, some), np.int64, len(some))
            state = np.full(len(some), self.start, np.int32)
            for t in range(width):
                live = np.searchsorted(size, t, side="right")  # words longer than t
                state[live:] = self.table[state[live:], coded[live:, t]]
            out[order[lo : lo + 8192]] = self.accept[state]
        return out


class Lexicon:
    """Terms and stems, and the words that are never taken for misspellings."""

    def __init__(self, terms: set[str], stems: set[str], clean: frozenset[str] = frozenset()) -> None:
        self.terms, self.stems, self.clean = terms, stems, clean
        self.lengths = {len(s) for s in stems}
        self.near = LevenshteinTrie(sorted(t for t in terms if len(t) >= SHORT), 1)
        self.far = LevenshteinTrie(sorted(t for t in terms if len(t) >= LONG), 2)
        self.longest = max(map(len, terms), default=0) + 2  # no longer word is within two edits
        self.memo: dict[str, int] = {}

    def misspelled(self, words: list[str]) -> np.ndarray:
        """Which words are within one edit of a term (of two, if both have ``LONG`` letters)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        fits = [w if len(w) <= self.longest else "" for w in words]
        return (sizes >= SHORT - 1) & self.near.accepts(fits) | (sizes >= LONG) & self.far.accepts(fits)

    def learn_words(self, words: set[str]) -> None:
        """Puts the kinds of words as written into the memo: 0 no hit, 1 term, 2 stem, 3 misspelled term."""
        memo, open_, read_as = self.memo, [], []
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w in memo:
                continue
            low = w.lower()
            memo[w] = 0
            if low in self.terms:
                memo[w] = 1
            elif any(low[:k] in self.stems for k in self.lengths if len(low) > k):
                memo[w] = 2
            elif low not in self.clean and len(low) >= SHORT - 1:
                open_.append(w)
                read_as.append(low if low.isalpha() else low.translate(LOOK_ALIKE).replace("*", "").replace("'", "").replace("’", ""))
        if open_:
            for k in np.flatnonzero(self.misspelled(read_as)).tolist():
                memo[open_[k]] = 3

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, see PRIOR."""
        out = np.zeros((len(texts), len(PRIOR)))
        for lo in range(0, len(texts), STEP):
            some = texts[lo : lo + STEP]
            words = [set(WORDS.findall(t)) if t else set() for t in some]
            self.learn_words(set().union(*words))
            memo = self.memo
            for k, (text, mine) in enumerate(zip(some, words, strict=True)):
                kinds = {w for w in mine if memo[w]}
                out[lo + k] = self._row(self.hits(text, kinds) if kinds else [])
        return out

    @staticmethod
    def _row(hits: list[tuple[int, bool]]) -> list[float]:
        kinds = [k for k, quoted in hits if not quoted]
        quoted = len(hits) - len(kinds)
        return [1.0, float(bool(kinds)), math.log1p(max(0, len(kinds) - 1)), float(set(kinds) == {2}), float(set(kinds) == {3}), float(quoted > 0), math.log1p(max(0, quoted - 1))]

    def hits(self, text: str, kinds: set[str]) -> list[tuple[int, bool]]:
        """Kind and quotedness of each occurrence of the words ``kinds``."""
        memo = self.memo
        out = []
        spans = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(text)]
        for at, (w, start, end) in enumerate(spans):
            if w in kinds:
                lo, hi = max(0, at - WINDOW), min(len(spans), at + WINDOW + 1)
                before, after = text[spans[lo][1] : start], text[end : spans[hi - 1][2] + 2]
                near = {x.lower() for x, _, _ in spans[lo:hi]}
                quoted = _opened(before) and any(q in after for q in QUOTES) or not near.isdisjoint(REPORTING)
                out.append((memo[w], quoted))
        return out


def _opened(before: str) -> bool:
    """Whether a quotation mark of the text before a hit isn't closed there (an apostrophe inside a word isn't one)."""
    marks = re.sub(r"(?<=\w)['’](?=\w)", "", before)
    return sum(marks.count(q) for q in QUOTES) % 2 == 1


def distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``rows`` without copies and near copies: a text goes if it shares one of four min-hashes of its word triples
    with an earlier one (copies of one toxic document would make all its words look toxic)."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in rows:
        words = WORDS.findall(text)
        grams = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], "<u8")
        keys = {(k, int((grams * np.uint64(m)).min())) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))}
        if seen.isdisjoint(keys):
            out.append((text, label))
        seen |= keys
    return out


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """From (text, toxic) pairs: entries far more frequent in toxic documents, in more of them than chance explains."""
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for text, label in rows:
        words = {w.lower() for w in set(WORDS.findall(text))}
        entries = words | {f"{w[:k]}*" for w in words for k in STEM_LENGTHS if len(w) > k}
        (toxic if label else clean).update(entries)
        n[bool(label)] += 1
    terms, stems = set(SEED_TERMS), set()
    if n[0] and n[1]:
        some = sum(k > 1 for k in toxic.values())
        # so many toxic documents by chance: less than one entry in twenty lexicons
        least = max(3, math.ceil(math.log(20 * max(1, some)) / math.log(sum(n) / n[1])))
        found = {e: k for e, k in toxic.items() if k >= least and k / n[1] >= 25 * (clean[e] + 0.3) / n[0] and len(e) >= 4}
        forms: dict[str, int] = {}
        for e, k in found.items():
            if e[-1] != "*":
                for size in STEM_LENGTHS:
                    forms[e[:size]] = max(forms.get(e[:size], 0), k)
        for e, k in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
            if any(e.startswith(s) for s in stems):
                continue
            if e[-1] != "*":
                terms.add(e)
            elif forms.get(e[:-1], 0) < 0.7 * k:  # several words, none of which explains the stem alone
                longer = [x for x, m in found.items() if x[-1] == "*" and x.startswith(e[:-1]) and m >= 0.95 * k]
                stems.add(max(longer, key=lambda x: (len(x), x))[:-1])
        terms = {t for t in terms if t in SEED_TERMS or not any(t.startswith(s) for s in stems)}
    first = Lexicon(terms, stems)
    known = [w for w in clean if w[-1] != "*" and SHORT - 1 <= len(w) <= first.longest]
    return Lexicon(terms, stems, frozenset(np.array(known, object)[first.misspelled(known)].tolist()) if known else frozenset())


def fit(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic model: penalised towards PRIOR, by damped Newton steps."""
    w = PRIOR.copy()
    if not len(labels):
        return w

    def loss(v: np.ndarray) -> float:
        z = features @ v
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.sum(PRECISION * (v - PRIOR) ** 2))

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - labels) + PRECISION * (w - PRIOR)
        curve = (features * (p * (1 - p))[:, None]).T @ features + np.diag(PRECISION)
        step, size, now = np.linalg.solve(curve, gradient), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from the bounded sample of labelled rows whose crc32(doc_id) mod ``modulus`` isn't ``held``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("l_doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic IS NOT NULL AND l_doc_id IS NOT NULL").where(crc_mod("l_doc_id", modulus) != held)
    marks = marks.withColumn("h", F.xxhash64("l_doc_id")).orderBy("h", "l_doc_id", "toxic").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    # at most SAMPLE rows: small enough to send to every task
    rows = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("l_doc_id")).select("h", "doc_id", "text", "toxic")
    held_rows = sorted({(r.h, r.doc_id, r.text or "", r.toxic) for r in rows.toLocalIterator()})
    pairs = [(text, toxic) for _, _, text, toxic in held_rows]
    pairs = distinct_texts(pairs)
    # weights come from documents that the lexicon of the other half hasn't seen
    halves = pairs[::2], pairs[1::2]
    features, marked = [], []
    for own, other in (halves, halves[::-1]):
        lexicon = learn_lexicon(other)
        features.append(lexicon.features([t for t, _ in own]))
        marked += [y for _, y in own]
    return learn_lexicon(pairs), fit(np.concatenate(features), np.array(marked, float))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon, weights = learn(part, labels, modulus, held)
    run = _scorer(part, lexicon, weights)
    rows = part.select("doc_id", F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scorer(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray):
    """For mapInArrow: replaces the last column, a text, by its score."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.stems, lexicon.clean, weights))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems, clean, w = shared.value
        own = Lexicon(terms, stems, clean)
        for batch in it:
            z = own.features(batch.column(batch.num_columns - 1).to_pylist()) @ w
            columns = [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score"])

    return batches


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic."""
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon, weights = learn(part, labels)
    run = _keeper(docs, lexicon, weights)
    return docs.mapInArrow(run, docs.schema)


def _keeper(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray):
    """For mapInArrow: drops rows whose text scores 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.stems, lexicon.clean, weights))
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems, clean, w = shared.value
        own = Lexicon(terms, stems, clean)
        for batch in it:
            z = own.features(batch.column(at).to_pylist()) @ w
            yield batch.filter(pa.array(z < 0))

    return batches
