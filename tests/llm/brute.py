"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WS = r"[^\x20\x09-\x0D]+"


def repeated_bytes(docs: dict[int, str | None], depth: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    seen: dict[bytes, int] = {}
    out = {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        cover = bytearray(len(b))
        windows = [b[p : p + depth] for p in range(len(b) - depth + 1)]
        for p, w in enumerate(windows):
            if w in seen:
                cover[p : p + depth] = b"\1" * depth
        for w in windows:
            seen.setdefault(w, i)
        kept = bytes(c for c, f in zip(b, cover, strict=True) if not f)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()
    return out


def shingles(text: str | None, n: int = 5) -> collections.Counter:
    w = re.findall(WS, text or "")
    if len(w) < n:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def probability_jaccard(a: collections.Counter, b: collections.Counter) -> float:
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1.0 / sum(max(a[z] / a[x], b[z] / b[x]) for z in a.keys() | b.keys())
    return total


def classes(docs: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i].keys() & sets[j].keys() and find(i) != find(j) and probability_jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(WS, text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def licenses(text: str | None, phrases: dict[str, str], templates, least: float, span: int, step: int) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(pattern, low)
    starts, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for at in range(0, len(w), step):
        own = set(w[at : at + span])
        for label, template, naming in templates:
            t = set(template.split())
            if set(naming.split()) <= own and len(t & own) / len(t) >= least - 1e-9:
                labels.add(label)
                score = max(score, len(t & own) / len(t))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets: shares by weight, capped, the excess shared again until none is over."""
    left, open_, out = total * sum(sizes.values()), set(sizes), {}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out
