"""Texts as numpy arrays: folded characters, hashed words and within-word character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from millrace.llm.common import text_slices

SLICE = 1 << 18  # characters handled at once: the temporary arrays stay in the processor's cache
_NO_LETTER = re.compile(r"[\W\d_]")
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point the lower-case letter, or a space for what is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    return _FOLD[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, text or part of it). Texts over ``SLICE`` characters are cut where they have no letter, which changes no word; a word is never cut."""
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > SLICE:
            found = _NO_LETTER.search(text, at + SLICE)
            if not found:
                break
            yield row, text[at : found.start()]
            at = found.start()
        yield row, text[at:]


def folded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (row of each character, folded characters): words in single spaces, one before and after each text."""
    table = fold_table()
    rows, parts = zip(*pieces(texts), strict=True) if texts else ((), ())
    for a, b in text_slices(list(parts), SLICE):
        lengths = np.fromiter((len(p) + 2 for p in parts[a:b]), np.int64, b - a)
        chars = table[code_points("".join(f" {p} " for p in parts[a:b]))]
        row = np.repeat(np.asarray(rows[a:b], np.int32), lengths)
        ends = np.cumsum(lengths)
        gap = chars == 32
        first = np.zeros(len(chars), bool)
        first[0] = True
        first[ends[:-1]] = True
        keep = ~gap
        keep[0] = True
        keep[1:] |= ~gap[:-1]
        keep |= first
        yield row[keep], chars[keep]


def words(row: np.ndarray, chars: np.ndarray, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words of at most ``longest`` letters, and of the 5-grams of longer ones."""
    inside = chars != 32
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    long = np.flatnonzero(end - begin > longest)
    if len(long):  # a long word with the spaces around it
        lo, n = begin[long] - 1, end[long] - begin[long] + 2
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        r, b = grams(row[at], chars[at], 5, bits)
    keep = end - begin <= longest
    begin, n = begin[keep], (end - begin)[keep]
    h = np.full(len(begin), 7, np.uint64)
    for k in range(longest):
        live = n > k
        if not live.any():
            break
        h[live] = h[live] * np.uint64(0x9E3779B97F4A7C15) + chars[begin[live] + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    found = row[begin], (h >> np.uint64(64 - bits)).astype(np.int64)
    return (np.concatenate([found[0], r]), np.concatenate([found[1], b])) if len(long) else found


def grams(row: np.ndarray, chars: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the character n-grams that lie in one word with its surrounding spaces."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    word = chars != 32
    ok = row[:m] == row[n - 1 :]
    for k in range(1, n - 1):
        ok &= word[k : k + m]
    if n > 1:
        ok &= word[:m] | word[n - 1 : n - 1 + m]
    else:
        ok &= word[:m]
    at = np.flatnonzero(ok)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[at + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return row[at], (h >> np.uint64(64 - bits)).astype(np.int64)
