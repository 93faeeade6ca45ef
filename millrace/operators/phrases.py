"""Phrases of one to three words of documents, counted and scored over arrays of word numbers within a task.

What belongs to a phrase lies in its document, so texts are dealt by doc_id once and nothing else moves. A slice of a
partition's documents becomes arrays: each distinct word is judged once, and counts, first places and neighbours come
from sorted numbers. The rules are those of ``keyphrase``'s columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2_000_000  # characters of documents that are held as arrays at once; a longer document is a slice of its own
SENTENCE_END = re.compile("(?<=[.!?]) +")
TOKEN = re.compile(r"[\w-]+|[^ \t\n\x0b\f\r\w-]+")  # \w: letters, numbers and _
MARKS = re.compile(r"[!-/:-@\[-`{-~]")
MARK = re.compile(r"[!-/:-@\[-`{-~]+\Z")
DECIMAL = re.compile(r"([^.]*)\.([^.]*)\Z")
TAGS = {t: i for i, t in enumerate("panud")}
PLAIN = TAGS["u"]  # tags below it are those of plain words


def dealt(documents: DataFrame) -> DataFrame:
    """(doc_id, text): all rows of a document stand together in one partition."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").sortWithinPartitions("doc_id")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """About ``SLICE`` characters each; no document is cut."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if size >= SLICE and i != ids[-1]:
                yield read(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
    if ids:
        yield read(ids, texts)


def sentences(text: str) -> list[str]:
    flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return [s for s in (s.strip(" ") for s in SENTENCE_END.split(flat)) if s]


def tag(word: str) -> str:
    """The tag inside a sentence: see ``functions.text.tag``; a word that begins one has p for n."""
    if word.isascii() and word.isalpha() and word.islower():
        return "p"
    kinds = {unicodedata.category(c) for c in word}
    if kinds == {"Ll"}:
        return "p"
    number = word.replace(",", "")
    if (m := DECIMAL.match(number)) is not None:
        number = m[1] + m[2]
    if number.isdecimal():
        return "d"
    digit, letter = "Nd" in kinds, any(k[0] == "L" for k in kinds)
    if digit == letter or len(MARKS.findall(word)) > 1:
        return "u"
    if "Lu" in kinds and "Ll" not in kinds:
        return "a"
    upper = unicodedata.category(word[0]) == "Lu" and all(unicodedata.category(c) != "Lu" for c in word[1:])
    return "n" if len(word) > 1 and upper else "p"


@dataclass(frozen=True)
class Slice:
    """Words of a slice's documents, in order; ``of`` and the like hold a number for each of them."""

    ids: list  # of the documents
    all_sents: np.ndarray  # of each document
    of: np.ndarray  # document
    sent: np.ndarray
    word: np.ndarray  # number in words, lows and stops
    tag: np.ndarray
    term: np.ndarray
    low: np.ndarray
    after_one: np.ndarray  # a word of its block stands before it
    after_two: np.ndarray
    words: pa.Array
    lows: pa.Array
    terms: list[str]  # of each distinct word

    @cached_property
    def runs(self) -> list[Runs]:
        """The distinct phrases of one, two and three words of each document."""
        _, first, one, count = np.unique(self.of * (self.low.max(initial=0) + 1) + self.low, return_index=True, return_inverse=True, return_counts=True)
        n, plain = len(first), self.tag < PLAIN
        out = [Runs(1, first, count, np.bincount(one[plain], minlength=n) > 0)]
        at = np.flatnonzero(self.after_one)
        _, first, two, count = np.unique(one[at - 1] * n + one[at], return_index=True, return_inverse=True, return_counts=True)
        plain = plain & self.after_one & np.roll(plain, 1)
        out.append(Runs(2, at[first], count, np.bincount(two[plain[at]], minlength=len(first)) > 0))
        pair = np.zeros(len(one), np.int64)
        pair[at] = two
        at = np.flatnonzero(self.after_two)
        _, first, three, count = np.unique(pair[at - 1] * n + one[at], return_index=True, return_inverse=True, return_counts=True)
        plain = plain & np.roll(plain, 1)
        out.append(Runs(3, at[first], count, np.bincount(three[plain[at]], minlength=len(first)) > 0))
        return [r.where(r.clean) for r in out]

    def text(self, runs: Runs, lower: bool) -> pa.Array:
        """The phrases as first written, or in lower case."""
        number, strings = (self.low, self.lows) if lower else (self.word, self.words)
        parts = [strings.take(pa.array(number[runs.last - back])) for back in range(runs.n - 1, -1, -1)]
        return parts[0] if runs.n == 1 else pc.binary_join_element_wise(*parts, " ")


@dataclass(frozen=True)
class Runs:
    """Phrases of n words by the place of their first occurrence's last word, with their counts; clean: some occurrence has neither numbers nor mixed words."""

    n: int
    last: np.ndarray
    tf: np.ndarray
    clean: np.ndarray

    def where(self, kept: np.ndarray) -> Runs:
        return Runs(self.n, self.last[kept], self.tf[kept], self.clean[kept])


def read(ids: list, texts: list[str]) -> Slice:
    """``ids`` stand together where they are equal."""
    own: list = []
    found: list[tuple[int, int, list[str]]] = []
    all_sents: list[int] = []
    repeated = False
    for i, text in zip(ids, texts, strict=True):
        if not own or own[-1] != i:
            own.append(i)
            all_sents.append(0)
        else:
            repeated = True
        parts = sentences(text)
        all_sents[-1] = max(all_sents[-1], len(parts))
        found += [(len(own) - 1, s, TOKEN.findall(part)) for s, part in enumerate(parts)]
    if repeated:
        found.sort(key=lambda x: x[:2])
    sizes = np.array([len(x[2]) for x in found], np.int64)
    coded = pa.array([w for x in found for w in x[2]], pa.string()).dictionary_encode()
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    forms = words.to_pylist()
    mark = np.array([MARK.match(w) is not None for w in forms], bool)
    inside = np.array([TAGS[tag(w)] for w in forms], np.int8)
    lower = [w.lower() for w in forms]
    terms = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in lower]
    numbered = lambda strings: pa.array(strings, pa.string()).dictionary_encode()
    low, term = numbered(lower), numbered(terms)
    sentence = np.repeat(np.arange(len(found)), sizes)
    begins = np.ones(len(word), bool)
    begins[1:] = sentence[1:] != sentence[:-1]
    marked = mark[word] if len(word) else np.zeros(0, bool)
    after_one = ~begins & ~np.roll(marked, 1)
    after_two = after_one & np.roll(after_one, 1)
    kept = np.flatnonzero(~marked)
    word, sentence = word[kept], sentence[kept]
    inner = np.zeros(len(word), bool)
    inner[1:] = sentence[1:] == sentence[:-1]
    place = np.array([x[:2] for x in found], np.int64).reshape(-1, 2)[sentence]
    tags = np.where(~inner & (inside[word] == TAGS["n"]), TAGS["p"], inside[word]).astype(np.int8)
    number = lambda coded: coded.indices.to_numpy().astype(np.int64)[word]
    return Slice(own, np.array(all_sents, np.int64), place[:, 0], place[:, 1], word, tags, number(term), number(low), after_one[kept], after_two[kept], words, low.dictionary, terms)


@dataclass(frozen=True)
class Scored:
    """Phrases that neither begin nor end with a stopword; s is nan where ``under`` is 0."""

    runs: Runs
    s: np.ndarray
    under: np.ndarray


def scored(x: Slice, stopwords: tuple[str, ...]) -> list[Scored]:
    """Scores of the slice's phrases, those of n words in the nth place: see ``keyphrase.scored_terms`` and ``keyphrase.phrase_scores``."""
    docs = len(x.ids)
    kinds = x.term.max(initial=0) + 1
    _, first, group, tf = np.unique(x.of * kinds + x.term, return_index=True, return_inverse=True, return_counts=True)
    n, of = len(first), x.of[first]
    listed = frozenset(stopwords)
    stops = np.array([w.lower() in listed or t in listed or len(MARKS.sub("", t)) < 3 for w, t in zip(x.words.to_pylist(), x.terms, strict=True)], bool)
    stop = stops[x.word[first]] if n else np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    by, sent = group[order], x.sent[order]
    new = np.ones(len(by), bool)
    new[1:] = (by[1:] != by[:-1]) | (sent[1:] != sent[:-1])
    sent = sent[new]
    n_sents = np.bincount(by[new], minlength=n)
    start = np.cumsum(n_sents) - n_sents
    median = (sent[start + (n_sents - 1) // 2] + sent[start + n_sents // 2]) / 2.0

    plain = x.tag < PLAIN
    at = np.flatnonzero(x.after_one & plain & np.roll(plain, 1))
    edges, weight = np.unique(group[at - 1] * n + group[at], return_counts=True)
    ratio = lambda ends: np.bincount(ends, minlength=n) / np.maximum(np.bincount(ends, weights=weight, minlength=n), 1)
    pwl, pwr = (ratio(edges % n), ratio(edges // n)) if n else (np.zeros(0), np.zeros(0))

    top = np.zeros(docs, np.int64)
    np.maximum.at(top, of, tf)
    count = np.bincount(of[~stop], minlength=docs)
    mean = np.bincount(of[~stop], weights=tf[~stop], minlength=docs) / np.maximum(count, 1)
    std = np.sqrt(np.bincount(of[~stop], weights=(tf[~stop] - mean[of[~stop]]) ** 2, minlength=docs) / np.maximum(count, 1))
    share = tf / top[of]
    rel = (0.5 + pwl * share) + (0.5 + pwr * share)
    tagged = lambda t: np.bincount(group[x.tag == TAGS[t]], minlength=n)
    case = np.maximum(tagged("a"), tagged("n")) / (1 + np.log(tf))
    with np.errstate(divide="ignore", invalid="ignore"):
        under = case + tf / (mean + std)[of] / rel + n_sents / x.all_sents[of] / rel
        h = np.where((count[of] == 0) | (under == 0), 0.0, np.log(np.log(3 + median)) * rel / under)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often the terms stand side by side."""
        key = a * n + b
        at = np.searchsorted(edges, key)
        at[at == len(edges)] = 0
        return np.where(edges[at] == key, weight[at], 0) if len(edges) else np.zeros(len(key), np.int64)

    out = []
    for runs in x.runs:
        runs = runs.where(~stop[group[runs.last - runs.n + 1]] & ~stop[group[runs.last]])
        t = [group[runs.last - runs.n + 1 + i] for i in range(runs.n)]
        total, product = h[t[0]], h[t[0]]
        if runs.n == 2:
            total, product = total + h[t[1]], product * h[t[1]]
        elif runs.n == 3:
            p = joined(t[0], t[1]) / tf[t[0]] * (joined(t[1], t[2]) / tf[t[2]])
            bridged = stop[t[1]]
            total = total + np.where(bridged, -(1 - p), h[t[1]]) + h[t[2]]
            product = product * np.where(bridged, 2 - p, h[t[1]]) * h[t[2]]
        under = (total + 1) * runs.tf
        out.append(Scored(runs, np.divide(product, under, out=np.full(len(under), np.nan), where=under != 0), under))
    return out


def best(x: Slice, found: list[Scored], top: int, dedup: float) -> tuple[np.ndarray, list[int], list[str], list[float]]:
    """(document, rank, phrase, score) of each document's best phrases, without near-copies of better ones, in order of (score, lower case)."""
    n = np.concatenate([np.full(len(f.s), f.runs.n) for f in found])
    last, s = np.concatenate([f.runs.last for f in found]), np.concatenate([f.s for f in found])
    shown = np.round(s, 12)
    order = np.lexsort((shown, x.of[last]))  # nan comes last
    n, last, s, shown = n[order], last[order], s[order], shown[order]
    of = x.of[last]
    new = np.ones(len(of) + 1, bool)
    new[1:-1] = (of[1:] != of[:-1]) | ((shown[1:] != shown[:-1]) & ~(np.isnan(shown[1:]) & np.isnan(shown[:-1])))
    ties = np.flatnonzero(new)
    lows, words = x.lows.to_pylist(), x.words.to_pylist()
    text = lambda i, strings, number: " ".join(strings[number[at]] for at in range(last[i] - n[i] + 1, last[i] + 1))
    docs: list[int] = []
    ranks: list[int] = []
    phrases: list[str] = []
    scores: list[float] = []
    doc, kept = -1, []
    for begin, end in pairwise(ties.tolist()):
        if of[begin] != doc:
            doc, kept = of[begin], []
        if len(kept) == top:
            continue
        for key, i in sorted((text(i, lows, x.low), i) for i in range(begin, end)):
            if len(kept) == top:
                break
            if not any(similar(key, k, dedup) for k in kept):
                kept.append(key)
                docs.append(doc)
                ranks.append(len(kept))
                phrases.append(text(i, words, x.word))
                scores.append(None if np.isnan(s[i]) else float(s[i]))
    return np.array(docs, np.int64), ranks, phrases, scores


def counts(x: Slice) -> Iterator[pa.RecordBatch]:
    """(n, key, docs, tf): the slice's phrases in lower case, each once."""
    for runs in x.runs:
        number = x.low[runs.last - runs.n + 1]
        for back in range(runs.n - 2, -1, -1):
            number = np.unique(number, return_inverse=True)[1] * (x.low.max(initial=0) + 1) + x.low[runs.last - back]
        _, first, of = np.unique(number, return_index=True, return_inverse=True)
        tf = np.bincount(of, weights=runs.tf, minlength=len(first)).astype(np.int64)
        key = x.text(runs.where(first), lower=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), runs.n, np.int32)), key, pa.array(np.bincount(of, minlength=len(first))), pa.array(tf)], names=["n", "key", "docs", "tf"])


@lru_cache(maxsize=10_000)
def _allowed(longer: int, most: float) -> int:
    """Most edits with which two texts are similar; -1 if none is."""
    k = -1
    while k < longer and 1 - (k + 1) / longer > most:
        k += 1
    return k


def similar(a: str, b: str, most: float) -> bool:
    """Whether 1 - edit distance / longer length is over ``most``; equal texts are similar."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = _allowed(len(b), most)
    if len(b) - len(a) > k or k < 1:
        return False
    begin = 0
    while begin < len(a) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < len(a) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    far = k + 1
    row = [j if j <= k else far for j in range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        low, high = max(1, i - k), min(len(b), i + k)
        before, row[low - 1] = row[low - 1], i if low == 1 and i <= k else far
        for j in range(low, high + 1):
            before, row[j] = row[j], min(row[j] + 1 if j < i + k else far, row[j - 1] + 1, before + (c != b[j - 1]), far)
        if min(row[low - 1 : high + 1]) >= far:
            return False
    return row[-1] <= k
