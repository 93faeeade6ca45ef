"""Weighted five-word shingles and their ProbMinHash signatures, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from millrace.llm.common import text_slices
from millrace.llm.textvec import code_points

WORDS = 5
SLOTS = 120
SLICE = 1 << 18
_ODD = (np.random.default_rng(5).integers(1 << 62, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gaps(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


def word_hashes(chars: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words: runs of characters other than the six ASCII white-space ones. A gap must end each row."""
    gap = _gaps(chars)
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    place = np.arange(len(chars))
    place[begins[0] :] -= np.repeat(begins, np.diff(np.append(begins, len(chars))))
    value = (chars + np.uint64(1)) * _ODD[place & 63]
    value += (place >> 6).astype(np.uint64) * _A
    value = mix(value)
    value[gap] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    return row[begins], mix(total[ends] - total[begins] + _A)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, rows, hashes) of the distinct-order words of slices of the texts. A text is never cut."""
    for a, b in text_slices(texts, SLICE):
        part = [f"{t or ''}\n" for t in texts[a:b]]
        lengths = np.fromiter(map(len, part), np.int64, b - a)
        row, word = word_hashes(code_points("".join(part)).astype(np.uint64), np.repeat(np.arange(b - a), lengths))
        yield a, b, row, word


def weighted_shingles(row: np.ndarray, word: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, occurrences) by row and shingle. Rows of one to four words have one shingle of them all."""
    n = np.bincount(row, minlength=rows)
    m = len(word)
    h = np.zeros(m, np.uint64)
    left = (np.cumsum(n)[row] - np.arange(m)) if m else np.zeros(0, np.int64)  # words from here to the end of the row
    for k in range(WORDS):
        at = np.minimum(np.arange(m) + k, m - 1)
        h = np.where(left > k, mix(h * _A + word[at] + np.uint64(k + 1)), h)
    first = left == n[row]
    ok = (left >= WORDS) | (first & (n[row] < WORDS))
    row, h = row[ok], h[ok]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], h[begin], np.diff(np.append(begin, len(h)))


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """rows x SLOTS: in each slot the shingle that arrives first.

    A shingle arrives by a Poisson process of rate ``weight``, each time in a random slot; processes depend on the
    shingle alone. A process ends at its first arrival after the last first one of its row. Arrivals are drawn in
    rounds of doubling length. Two rows agree in a slot with the probability Jaccard similarity of their weights.
    """
    best = np.full(rows * SLOTS, np.inf)
    owner = np.zeros(rows * SLOTS, np.uint64)
    time = np.zeros(len(row))
    base, done, step = row * SLOTS, 0, 1
    while len(row):
        for _ in range(step):
            bits = mix(shingle + np.uint64((done + 1) * int(_A) & (1 << 64) - 1))
            done += 1
            time = time - np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
            slot = base + (mix(bits ^ _B) >> np.uint64(32)).astype(np.int64) * SLOTS // (1 << 32)
            np.minimum.at(best, slot, time)
            won = best[slot] == time
            owner[slot[won]] = shingle[won]
        last = best.reshape(rows, SLOTS).max(axis=1)
        live = time < last[row]
        row, shingle, weight, time, base = row[live], shingle[live], weight[live], time[live], base[live]
        step = min(2 * step, 16) if len(row) < 4096 else 1
    return owner.reshape(rows, SLOTS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles of 1 / sum over all shingles z of max(a_z / a_x, b_z / b_x), exactly.

    (shingles in ascending order, weights). With the ratios r_z = b_z / a_z in order, prefix sums give each term.
    """
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    only_a, only_b = wa.sum() - wa[i].sum(), wb.sum() - wb[j].sum()
    x, y = wa[i], wb[j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # for common z before x in order b_z / b_x <= a_z / a_x, so the maximum is a_z / a_x; after it, b_z / b_x
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1.0 / ((below + only_a) / x + (above + only_b) / y)).sum())
