"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by vocabulary score (then by position)
and merges the best pair until none is in the vocabulary; symbols left outside the vocabulary fall
back to byte pieces.  No piece holds a space mark after another character, nor a line break, so a text
falls apart at those places into stretches that are merged independently; recurring stretches are
merged once per Arrow batch sequence (a bounded memo).

Results for odd input
    null or empty text: begin and end ids only, decoded text empty.  Repeated rows: one result each.
    Very long stretches: the agenda is a heap, so work is ``n log n``.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of a worker's memo and length of the longest stretch that it holds.
MEMO, MEMO_LEN = 200_000, 48
#: Begins a memo key that is a stretch as it stands, not a word after a space mark (a character of no text's own key).
MARKED = SPACE
NEVER, END, GONE = np.iinfo(np.int32).max, -9, -8
HASH, MASK64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class AgendaEncoder:
    """Encodes and decodes with a merge-type SentencePiece model given as its file's bytes.

    ``check``: every stretch that a call meets for the first time, of any length and kind, is compared with the
    library's encoding, and a difference is an error.  There is no check in part.
    """

    def __init__(self, model: bytes, check: bool = True) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.check = bool(check)
        self.pieces: dict[str, tuple[float, int]] = {}
        byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[sp.id_to_piece(i)] = (-sp.get_score(i), i)
        self.byte_ids = [byte_ids.get(b, unk) for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece holds a space mark or a line break inside it; stretches would not be independent")
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.memo: dict[str, bytes] = {}
        self._pair_table()

    def _pair_table(self) -> None:
        """Open-addressed table from a pair of symbols to the symbol that it makes and its rank.

        Symbols: a piece's id, or a number from the vocabulary's size for a character that only occurs inside pieces.
        """
        size = self.library.get_piece_size()
        self.symbol = {p: i for p, (_, i) in self.pieces.items()}
        for p in list(self.pieces):
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        order = {s: k for k, s in enumerate(sorted({s for s, _ in self.pieces.values()}))}
        keys, made, rank = [], [], []
        for p, (score, i) in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
                    rank.append(order[score])
        self.bits = max(10, 2 + len(keys).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.zeros(1 << self.bits, np.int32)
        self.rank = np.full(1 << self.bits, NEVER, np.int32)
        for k, m, r in zip(keys, made, rank, strict=True):
            at = (k * HASH & MASK64) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.made[at], self.rank[at] = k, m, r
        filled = np.flatnonzero(self.keys >= 0)
        home = ((self.keys[filled].astype(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        self.probes = int(((filled - home) & ((1 << self.bits) - 1)).max(initial=0)) + 1

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no such piece) and merged symbol of each pair; negative symbols match nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        at = ((key.astype(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        rank, made = np.full(len(key), NEVER, np.int32), np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[at[hit]], self.made[at[hit]]
            go = ~hit & (found >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return rank, made

    def merge_many(self, stretches: list[str]) -> list[bytes]:
        """Ids of short stretches, whose agendas are the rows of one matrix: in each round every row merges
        its best-scored adjacent pair (the leftmost of equals), and only the two pairs beside it are looked up again."""
        n, width = len(stretches), max(map(len, stretches))
        if width == 1:
            width = 2
        chars = np.array(stretches, dtype=f"<U{width}").view("<u4").reshape(n, width)
        sym = self.of_char[chars]
        lengths = np.fromiter(map(len, stretches), np.int64, n)
        sym[np.arange(width) >= lengths[:, None]] = END
        agenda, made = np.full((n, width), NEVER, np.int32), np.zeros((n, width), np.int32)
        r, m = self._look_up(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        agenda[:, :-1], made[:, :-1] = r.reshape(n, -1), m.reshape(n, -1)
        # symbols of a row form a linked list over flat positions; a merged one keeps its left place
        flat, later = sym.ravel(), np.arange(1, n * width + 1)
        earlier = later - 2
        earlier[::width] = -1
        later[width - 1 :: width] = -1
        ranks, makes = agenda.ravel(), made.ravel()
        live = np.arange(n)
        while len(live):
            best = agenda[live].argmin(1) + live * width if len(live) < n else agenda.argmin(1) + live * width
            go = ranks[best] < NEVER
            live, best = live[go], best[go]
            gone = later[best]
            after, before = later[gone], earlier[best]
            flat[best], flat[gone], ranks[gone] = makes[best], GONE, NEVER
            later[best] = after
            has = after >= 0
            earlier[after[has]] = best[has]
            right = np.where(has, flat[after], END)
            to = before >= 0
            left, now = before[to], flat[best]
            k = len(best)
            r, m = self._look_up(np.concatenate([now, flat[left]]), np.concatenate([right, now[to]]))
            ranks[best], makes[best] = r[:k], m[:k]
            ranks[left], makes[left] = r[k:], m[k:]
        size = self.library.get_piece_size()
        held = (sym != END) & (sym != GONE)
        odd = (held & ((sym < 0) | (sym >= size))).any(1)
        counts = held.sum(1)
        ids, ends = sym[held].astype("<u4").tobytes(), 4 * np.cumsum(counts)
        out = [ids[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():  # byte pieces for what is in no piece
            row: list[int] = []
            for x, c in zip(sym[k].tolist(), chars[k].tolist(), strict=True):
                if x not in (END, GONE):
                    row += [x] if 0 <= x < size else [self.byte_ids[b] for b in chr(c).encode()]
            out[k] = np.array(row, "<u4").tobytes()
        return out

    def merge(self, s: str) -> bytes:
        """Ids of one stretch of any length, by a heap of adjacent pairs."""
        pieces = self.pieces
        sym: list[str | None] = list(s)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(hit[0], i, i + 1, 2) for i in range(n - 1) if (hit := pieces.get(s[i : i + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            left, right = sym[a], sym[b]
            if left is None or right is None or nxt[a] != b or len(left) + len(right) != size:
                continue
            sym[a], sym[b] = left + right, None
            nxt[a] = c = nxt[b]
            if c >= 0:
                prev[c] = a
                if hit := pieces.get(sym[a] + sym[c]):
                    heapq.heappush(agenda, (hit[0], a, c, len(sym[a]) + len(sym[c])))
            if (p := prev[a]) >= 0 and (hit := pieces.get(sym[p] + sym[a])):
                heapq.heappush(agenda, (hit[0], p, a, len(sym[p]) + len(sym[a])))
        out: list[int] = []
        for x in sym:
            if x is not None:
                out += [pieces[x][1]] if x in pieces else [self.byte_ids[b] for b in x.encode()]
        return np.array(out, "<u4").tobytes()

    def stretches(self, text: str) -> list[str]:
        """The text's independent stretches, without the space mark that begins each."""
        if SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return text.split(" ") if text else []

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        # a plain word stands for itself after a space mark; stretches of the other kind begin with MARKED
        split = [self.stretches(t) for t in texts]
        for k, t in enumerate(texts):
            if len(split[k]) and (SPACE in t or "  " in t or t[:1] == " " or t[-1:] == " "):
                split[k] = [x[1:] if x[0] == SPACE and SPACE not in x[1:] and len(x) > 1 else MARKED + x for x in split[k]]
        extra: dict[str, bytes] = {}
        new = list({x for words in split for x in words if x not in memo})
        whole = [x[1:] if x[0] == MARKED else SPACE + x for x in new]
        short = sorted((k for k, x in enumerate(whole) if len(x) <= MEMO_LEN), key=lambda k: len(whole[k]))
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            memo.update(zip([new[k] for k in some], self.merge_many([whole[k] for k in some]), strict=True))
        for k, x in enumerate(whole):
            if len(x) > MEMO_LEN:
                extra[new[k]] = self.merge(x)
        if self.check:
            # the library puts a space mark before what it encodes: words stand behind it, the rest behind a line break
            ahead = self.library.encode("\n", num_threads=1)
            theirs = self.library.encode(["\n" + x[1:] if x[0] == MARKED else x for x in new], num_threads=1) if new else []
            for x, ids in zip(new, theirs, strict=True):
                if x[0] == MARKED:
                    if ids[: len(ahead)] != ahead:
                        raise RuntimeError("ids differ from the sentencepiece library's")
                    del ids[: len(ahead)]
            ours = [memo[x] if x in memo else extra[x] for x in new]
            lengths = np.fromiter(map(len, theirs), np.int64, len(new))
            if (lengths * 4 != np.fromiter(map(len, ours), np.int64, len(new))).any() or np.fromiter(chain.from_iterable(theirs), "<u4").tobytes() != b"".join(ours):
                raise RuntimeError("ids differ from the sentencepiece library's")
        begin, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        if extra:
            return [begin + b"".join([memo[x] if x in memo else extra[x] for x in words]) + end for words in split]
        return [begin + b"".join([memo[x] for x in words]) + end for words in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library's ``decode(ids)``."""
        return self.library.decode(ids, num_threads=1) if ids else []


def encode_documents(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids (binary), n_tokens, decoded text.

    ``check``: every stretch not met before is compared with the sentencepiece library.
    """
    run = _runner(docs, model, check)

    def rows(ids, keys, texts):
        return pa.RecordBatch.from_pydict({"doc_id": keys, "ids": ids, "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "decoded": texts})

    return run(rows, "doc_id long, ids binary, n_tokens long, decoded string")


def digest_documents(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """As :func:`encode_documents` with SHA-256 digests in place of ids and decoded text."""
    run = _runner(docs, model, check)

    def rows(ids, keys, texts):
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": keys,
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts],
            }
        )

    return run(rows, SCHEMA)


def _runner(docs: DataFrame, model: bytes, check: bool):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file: half a megabyte, whatever the input
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(rows, schema: str) -> DataFrame:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = AgendaEncoder(shared.value, check)
            for batch in it:
                for at in range(0, batch.num_rows, 256):  # bounds what one step holds
                    part = batch.slice(at, 256)
                    texts = part.column(1).to_pylist()
                    ids = encoder.encode_many(texts)
                    lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
                    yield rows(ids, part.column(0), encoder.decode(lists))

        return narrow.mapInArrow(batches, schema)

    return run
