"""Ranked lexical search: trees of document term vectors, searched depth-first with bounds for each item.

Documents are read once: of each, the number of its terms and the counts of those terms that items ask for go to a
table. Sums over it give N, L and the document frequencies. A task sorts a block of ``BLOCK`` vectors by their terms, most
frequent first, so that documents share the paths of a trie (FP-tree); neighbouring thin branches, under ``LEAF``
documents together, are one leaf. Each node holds the largest count of each term and the smallest m below it. As the
score grows with a count and falls with m, these bound what a subtree can score. A search follows the best child
first and leaves out what can't reach the item's tenth document so far, or reaches it with larger ids only. What is
found carries over to the task's next blocks; the tenths of all tasks then meet, item by item.

Items are taken in groups of ``ITEM_BYTES`` bytes of text, which bounds the vocabulary that tasks hold; each group reads the
documents once more. Bounds use the same integers as scores, so no document is lost.

Defined cases: null texts have no terms; a document without terms counts nowhere; items without a known term have no rows;
repeated documents are ranked each, equal ids in any order; a null doc_id comes after all others; items with equal
id and text are one item; with equal id and different texts each is ranked by itself; very long texts are cut in slices
between terms; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

TOP = 10
BLOCK = 8192  # documents of a tree
LEAF = 32
ITEM_BYTES = 1 << 20
SLICE = 1 << 22
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
_LAST = np.iinfo(np.int64).max  # stands for a null id in comparisons


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some MB at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _vectors(ids: dict[bytes, int]):
    """A function for mapInArrow: (doc_id, text) -> (doc_id, n, terms, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, found, counts = [], [], []
            for text in batch.column(1):
                c: Counter = Counter()
                for some in terms(text.as_py() or b""):
                    c.update(map(ids.get, some))
                ns.append(c.total())
                c.pop(None, None)
                found.append(list(c))
                counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"]
            )

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _part(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence of a weight of 1 adds: 0 without a count, growing with it, falling with m."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Tree:
    """A block of vectors as a trie over terms by rank, the most frequent first."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, counts: np.ndarray, width: int) -> None:
        """doc_ids, m: of each document; offsets: where its (rank, count) entries begin in ranks and counts, rank-ordered."""
        wide = ranks.astype(">u4")
        paths = [wide[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        size = np.diff(offsets)[order]
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        at = np.repeat(offsets[order] - self.begins, size) + np.arange(self.ends[-1])
        self.ranks, self.counts = ranks[at], counts[at]
        self.ids, self.m, self.size = doc_ids[order], m[order], size
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow()
        self._bound(width)

    def _grow(self) -> None:
        """Nodes level by level; the children of one stand together."""
        self.spans, self.children, depth = [(0, len(self.ids))], [None], [0]
        node = 0
        while node < len(self.spans):
            lo, hi = self.spans[node]
            if hi - lo > LEAF:
                cuts, d = self._cuts(lo, hi, depth[node])
                if len(cuts) > 2:
                    self.children[node] = len(self.spans), len(self.spans) + len(cuts) - 1
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        self.spans.append((a, b))
                        self.children.append(None)
                        depth.append(d)
            node += 1

    def _cuts(self, lo: int, hi: int, depth: int) -> tuple[list[int], int]:
        """Bounds of the branches below a shared path: where the next term differs, thin neighbours left together."""
        while True:
            there = self.size[lo:hi] > depth
            term = np.where(there, self.ranks[np.minimum(self.begins[lo:hi] + depth, len(self.ranks) - 1)], -1)
            ends = np.flatnonzero(np.diff(term)) + 1
            if len(ends) or not there.all():
                break
            depth += 1
        cuts = [lo]
        for end in [*(lo + ends).tolist(), hi]:
            if len(cuts) > 1 and end - cuts[-2] <= LEAF:
                cuts[-1] = end
            else:
                cuts.append(end)
        return cuts, depth + 1

    def _bound(self, width: int) -> None:
        """Of each subtree the largest count of each term, the smallest m and id."""
        n = len(self.spans)
        self.most = np.zeros((n, width), np.int64 if self.counts.max(initial=0) >= 1 << 31 else np.int32)
        self.least_m, self.least_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node in range(n - 1, -1, -1):
            lo, hi = self.spans[node]
            if self.children[node]:
                a, b = self.children[node]
                self.most[node] = self.most[a:b].max(0)
                self.least_m[node], self.least_id[node] = self.least_m[a:b].min(), self.least_id[a:b].min()
            else:
                a, b = self.begins[lo], self.ends[hi - 1]
                np.maximum.at(self.most[node], self.ranks[a:b], self.counts[a:b])
                self.least_m[node], self.least_id[node] = self.m[lo:hi].min(), self.ids[lo:hi].min()

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int, place: np.ndarray) -> int:
        """Adds to ``best``, a heap of (score, -doc_id), what belongs to the first ``top``; the number of nodes visited.

        ranks, weights: the item's terms and their weights times repeats; place: an array of -1 for each term, left as it was.
        """
        place[ranks] = np.arange(len(ranks))
        stack, visited = [(int(self._bounds(0, 1, ranks, weights)[0]), 0)], 0
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or len(best) == top and (bound, -int(self.least_id[node])) < best[0]:
                continue
            visited += 1
            if self.children[node]:
                a, b = self.children[node]
                bounds = self._bounds(a, b, ranks, weights)
                for i in np.argsort(bounds, kind="stable"):
                    stack.append((int(bounds[i]), a + int(i)))
            else:
                self._score(*self.spans[node], weights, best, top, place)
        place[ranks] = -1
        return visited

    def _bounds(self, a: int, b: int, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return _part(self.most[a:b, ranks].astype(np.int64), self.least_m[a:b, None]) @ weights

    def _score(self, lo: int, hi: int, weights: np.ndarray, best: list[tuple[int, int]], top: int, place: np.ndarray) -> None:
        a, b = self.begins[lo], self.ends[hi - 1]
        of = place[self.ranks[a:b]]
        hit = np.flatnonzero(of >= 0)
        doc = np.repeat(np.arange(hi - lo), self.size[lo:hi])[hit]
        scores = np.zeros(hi - lo, np.int64)
        np.add.at(scores, doc, weights[of[hit]] * _part(self.counts[a:b][hit], self.m[lo:hi][doc]))
        for i in np.flatnonzero(scores >= (best[0][0] if len(best) == top else 1)):
            entry = int(scores[i]), -int(self.ids[lo + i])
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """Trees of the documents that hold a term asked for, ``BLOCK`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, BLOCK - n)
            held.append(some)
            n, at = n + some.num_rows, at + some.num_rows
            if n == BLOCK:
                yield _tree(held, rank, n_docs, n_terms)
                held, n = [], 0
    if n:
        yield _tree(held, rank, n_docs, n_terms)


def _tree(held: list[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Tree:
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    n = table.column("n").to_numpy()
    lists, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(size)), size)
    ranks, counts = rank[lists.flatten().to_numpy()], counts.flatten().to_numpy()
    order = np.lexsort((ranks, doc))
    m = 25 + (75 * n * n_docs) // n_terms
    return Tree(ids, m, np.append(0, np.cumsum(size)), ranks[order], counts[order], len(rank))


def _search(items: list[tuple[int, dict[int, int]]], rank: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int, top: int):
    """A function for mapInArrow: the first ``top`` documents of a task for each item. items: (place, repeats by term)."""
    asked = []
    for place, repeats in items:
        ids = np.array([t for t in repeats if df[t]], np.int64)
        weights = np.array([repeats[t] * weight(n_docs, int(df[t])) for t in ids.tolist()], np.int64)
        asked.append((place, rank[ids], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {place: [] for place, _, _ in asked}
        marks = np.full(len(rank), -1, np.int64)
        for tree in _trees(batches, rank, n_docs, n_terms):
            for place, ranks, weights in asked:
                if len(ranks):
                    tree.search(ranks, weights, best[place], top, marks)
        rows = [(place, None if i == -_LAST else -i, s) for place, found in best.items() for s, i in found]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["place", "doc_id", "score"])

    return run


def _groups(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Distinct items, some MB of text at a time."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    held, size = [], 0
    for row in rows.toLocalIterator():
        text = bytes(row["text"] or b"")
        if held and size + len(text) > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text) + 64
    if held:
        yield held


def rank(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the first ``top`` documents (doc_id, text) of each item (item_id, text)."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    out = spark.createDataFrame([], RESULT)
    for i, group in enumerate(_groups(items)):
        found = _rank(documents, group, top, scratch, i)
        if found is not None:
            out = out.unionByName(found) if i else found
    return out


def _rank(documents: DataFrame, group: list[tuple[int | None, bytes]], top: int, scratch: Scratch, number: int) -> DataFrame | None:
    ids: dict[bytes, int] = {}
    repeats = []
    for _, text in group:
        c = Counter(t for some in terms(text) for t in some)
        repeats.append({ids.setdefault(t, len(ids)): n for t, n in c.items()})
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    vectors = scratch.save(docs.mapInArrow(_vectors(ids), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>").where("n > 0"), f"vectors{number}")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(ids), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the group
        df[row["t"]] = row["count"]
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((np.arange(len(ids)), -df))] = np.arange(len(ids))
    search = _search(list(enumerate(repeats)), order, df, n_docs, n_terms, top)
    hits = vectors.where(F.size("terms") > 0).mapInArrow(search, "place int, doc_id bigint, score bigint")
    first = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    names = documents.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], "place int, item_id bigint")
    return hits.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")
