"""Text functions: normalised lines, tokens, and the fuzzy score of two lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: What counts as white space in a line (fixed values): Unicode white space and the four information separators.
SPACES = r"[\s\u001C-\u001F\u0085   -     　]+"
TOKEN = "[A-Za-z][A-Za-z']+"


def normalise_line(line: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(line, f"(?! (?!{SPACES[:-1]})){SPACES}", " "))  # a plain space between words stays as it is


def tokens(text: Column, least: int = 4) -> Column:
    """Lower-case words of at least ``least`` letters and apostrophes."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0))
    return F.filter(found, lambda x: F.length(x) >= least)


def _common(x: str, y: str) -> int:
    """Length of the longest common subsequence, with a row of bits per character of ``y``."""
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    row = (1 << len(x)) - 1
    for c in y:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(x) - (row & ((1 << len(x)) - 1)).bit_count()


def common_many(xs: list[str], ys: list[str], need: np.ndarray) -> np.ndarray:
    """:func:`_common` of many pairs side by side; of a pair that can't reach ``need``, a number below it."""
    n, long_x, long_y = len(xs), np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    points = lambda some: np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
    places = lambda long: np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    row_x, row_y, at_x, x = np.repeat(np.arange(n), long_x), np.repeat(np.arange(n), long_y), places(long_x), points(xs)
    letters = np.flatnonzero(np.bincount(x, minlength=0x110000))
    width, words = len(letters) + 1, int(-(-long_x.max(initial=1) // 64))
    number = np.full(0x110000, width - 1)  # the last: in no x
    number[letters] = np.arange(width - 1)
    table = np.zeros((words, n * width), np.uint64)
    np.add.at(table.reshape(-1), at_x // 64 * (n * width) + row_x * width + number[x], np.uint64(1) << (at_x % 64).astype(np.uint64))
    steps = np.tile(np.arange(n) * width + width - 1, (int(long_y.max(initial=0)), 1))
    steps[places(long_y), row_y] = row_y * width + number[points(ys)]
    rows = np.full((words, n), np.iinfo(np.uint64).max, np.uint64)
    out, live = np.zeros(n, np.int64), np.arange(n)
    for k in range(len(steps)):
        at, carry = steps[k][live] if len(live) < n else steps[k], None
        for w in range(words):
            row = rows[w]
            hit = table[w].take(at) & row
            total = row + hit
            over = total < row
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            rows[w] = total | (row ^ hit)
        if k % 16 == 15 or k == len(steps) - 1:
            out[live] = 64 * words - np.bitwise_count(rows).sum(0, dtype=np.int64)
            left = long_y[live] - k - 1
            go = (left > 0) & (out[live] + left >= need[live])
            live, rows = live[go], rows[:, go]
            if not len(live):
                break
    return out


def token_set_score(a: str | None, b: str | None) -> int:
    """0 to 100: how alike two lines are as sets of words, the best of three comparisons, truncated.

    The common words, and those with each side's own words behind them, are compared by insertions and deletions.
    """
    one, two = set((a or "").split()), set((b or "").split())
    if not one or not two:
        return 0
    both = one & two
    own_a, own_b = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if both and (not own_a or not own_b):
        return 100
    sect = len(" ".join(sorted(both)))
    gap = 1 if sect else 0
    len_a, len_b = sect + gap + len(own_a), sect + gap + len(own_b)
    distance = len(own_a) + len(own_b) - 2 * _common(own_a, own_b)
    best = 100 - 100 * distance / (len_a + len_b) if len_a + len_b else 100.0
    if sect:
        best = max(best, 100 - 100 * (gap + len(own_a)) / (sect + len_a), 100 - 100 * (gap + len(own_b)) / (sect + len_b))
    return int(best)


def score_bound(one: frozenset[str], two: frozenset[str]) -> int:
    """A number that :func:`token_set_score` of two sets of words can't exceed, from the words' lengths alone."""
    if not one or not two:
        return 0
    both = one & two
    if both and (len(both) == len(one) or len(both) == len(two)):
        return 100
    shared = sum(map(len, both))
    sect = shared + len(both) - 1 if both else 0
    x = sum(map(len, one)) - shared + len(one) - len(both) - 1
    y = sum(map(len, two)) - shared + len(two) - len(both) - 1
    gap = 1 if sect else 0
    best = 100 - 100 * abs(x - y) / max(1, 2 * (sect + gap) + x + y)
    if sect:
        best = max(best, 100 - 100 * (gap + min(x, y)) / (2 * sect + gap + min(x, y)))
    return int(best)


def sequence_score(a: str | None, b: str | None) -> int:
    """0 to 100 by matching blocks (the standard library's), the plain alternative."""
    from difflib import SequenceMatcher

    return int(SequenceMatcher(None, a or "", b or "").ratio() * 100)


@F.pandas_udf(IntegerType())
def token_set_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """:func:`token_set_score` of two columns, in Arrow batches."""
    for a, b in pairs:
        yield pd.Series([token_set_score(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """:func:`sequence_score` of two columns, in Arrow batches."""
    for a, b in pairs:
        yield pd.Series([sequence_score(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def parse_colour(text: str) -> tuple[int, int, int]:
    """The three numbers from 0 to 255 of 'R,G,B'."""
    out = _three_numbers(text, "R,G,B")
    if not all(0 <= v <= 255 for v in out):
        raise ValueError(f"expected 'R,G,B' from 0 to 255, got {text!r}")
    return out


def parse_circle(text: str) -> tuple[int, int, int]:
    """The three numbers of 'cx,cy,r'."""
    return _three_numbers(text, "cx,cy,r")


def _three_numbers(text: str, form: str) -> tuple[int, int, int]:
    try:
        a, b, c = (int(v) for v in text.split(","))
    except ValueError:
        raise ValueError(f"expected {form!r}, got {text!r}") from None
    return a, b, c
