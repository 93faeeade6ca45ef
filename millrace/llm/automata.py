"""Weighted acyclic automata over word ids: built from sorted n-grams, minimised, united with summed weights, composed with paths.

An automaton holds n-grams of one length. A state of depth d is a range of arcs (label, payload); the payload is the
state of the next depth, or the weight where the n-gram ends. States with equal arcs are one state, so n-grams share
tails as well as prefixes. Ids are 64-bit integers from 0; arrays are as narrow as their values allow.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BQ")  # bytes of an item, items
_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the rows, the most significant first: as many columns in one integer as fit."""
    top = int(rows.max(initial=0))
    bits = max(1, top.bit_length())
    per = max(1, 62 // bits)
    keys = []
    for a in range(0, rows.shape[1], per):
        key = rows[:, a].copy()
        for c in range(a + 1, min(a + per, rows.shape[1])):
            key = (key << bits) | rows[:, c]
        keys.append(key)
    return keys


def summed(rows: np.ndarray, weights: np.ndarray, how: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the weights of equal ones put together."""
    if not len(rows):
        return rows, weights
    keys = _keys(rows)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(rows), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return rows[order[at]], how.reduceat(weights[order], at)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(next(t for t in _KINDS.values() if top <= np.iinfo(t).max))


class Automaton:
    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """levels: for each depth the first arc of each state (and the end of the last), labels and payloads of the arcs."""
        self.levels = levels

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> Automaton:
        """From distinct rows in lexicographic order. Depths are closed from the last one on, equal states at once."""
        n, width = rows.shape
        new = np.zeros(n, bool)
        new[:1] = True
        opens = []
        for d in range(width):
            new = new.copy()
            new[1:] |= rows[1:, d] != rows[:-1, d]
            opens.append(np.flatnonzero(new))
        payload, levels = np.asarray(weights, np.int64), []
        for d in range(width - 1, -1, -1):
            labels = rows[opens[d], d]
            starts = np.searchsorted(opens[d], opens[d - 1]) if d else np.zeros(1, np.int64)
            starts = np.append(starts, len(labels))
            level, of = cls._share(starts, labels, payload) if d else ((starts, labels, payload), None)
            levels.append(level)
            payload = of
        return cls(levels[::-1])

    @staticmethod
    def _share(starts: np.ndarray, labels: np.ndarray, payload: np.ndarray):
        """One state for equal ones; also the new state of each old one."""
        size = np.diff(starts)
        one = np.flatnonzero(size == 1)
        of = np.zeros(len(size), np.int64)
        x, y = labels[starts[one]], payload[starts[one]]
        order = np.lexsort((y, x))
        fresh = np.ones(len(one), bool)
        fresh[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
        of[one[order]] = np.cumsum(fresh) - 1
        first = one[order[fresh]]
        seen: dict[bytes, int] = {}
        more: list[int] = []
        for s in np.flatnonzero(size > 1):
            a, b = starts[s], starts[s + 1]
            sign = labels[a:b].tobytes() + payload[a:b].tobytes()
            if sign not in seen:
                seen[sign] = len(first) + len(more)
                more.append(s)
            of[s] = seen[sign]
        states = np.concatenate([first, np.array(more, np.int64)])
        length = size[states]
        ends = np.cumsum(length)
        arcs = np.repeat(starts[states] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return (np.append(0, ends), labels[arcs], payload[arcs]), of

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in lexicographic order, and their weights."""
        columns, state = [], np.zeros(1 if len(self.levels[0][1]) else 0, np.int64)
        for starts, labels, payload in self.levels:
            starts = starts.astype(np.int64)
            length = starts[state + 1] - starts[state]
            ends = np.cumsum(length)
            arcs = np.repeat(starts[state] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
            columns = [np.repeat(c, length) for c in columns] + [labels[arcs].astype(np.int64)]
            state = payload[arcs].astype(np.int64)
        return np.stack(columns, 1), state

    def weights(self, paths: np.ndarray) -> np.ndarray:
        """Composition with the paths: the weight of each row, 0 where it isn't accepted."""
        state, alive = np.zeros(len(paths), np.int64), np.ones(len(paths), bool)
        for d, (starts, labels, payload) in enumerate(self.levels):
            if not len(labels):
                return np.zeros(len(paths), np.int64)
            names, index = np.unique(labels, return_inverse=True)
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts.astype(np.int64)))
            arcs = of * len(names) + index
            label = np.minimum(np.searchsorted(names, paths[:, d]), len(names) - 1)
            at = np.minimum(np.searchsorted(arcs, state * len(names) + label), len(arcs) - 1)
            alive &= (names[label] == paths[:, d]) & (arcs[at] == state * len(names) + label)
            state = np.where(alive, payload[at].astype(np.int64), 0)
        return np.where(alive, state, 0)

    def dump(self) -> bytes:
        out = []
        for x in (_narrow(x) for level in self.levels for x in level):
            out += [_HEAD.pack(x.itemsize, len(x)), x.tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        arrays, at = [], 0
        while at < len(blob):
            size, n = _HEAD.unpack_from(blob, at)
            arrays.append(np.frombuffer(blob, _KINDS[size], n, at + _HEAD.size))
            at += _HEAD.size + size * n
        return cls([tuple(arrays[i : i + 3]) for i in range(0, len(arrays), 3)])


def union(automata: list[Automaton], how: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all automata with their weights put together. Pairs are united as soon as they are decoded, so memory is that of the result and one more."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for a in automata:
        parts.append(a.rows())
        while len(parts) > 1 and len(parts[-1][0]) * 2 >= len(parts[-2][0]):
            (x, v), (y, w) = parts.pop(), parts.pop()
            parts.append(summed(np.concatenate([y, x]), np.concatenate([w, v]), how))
    rows, weights = parts.pop()
    while parts:
        x, w = parts.pop()
        rows, weights = summed(np.concatenate([x, rows]), np.concatenate([w, weights]), how)
    return rows, weights
