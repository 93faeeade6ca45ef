"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical_search
from millrace.llm.lexical_search import Tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return Counter(TERM.findall((text or "").translate(LOW)))


def brute(docs, items, top=10):
    bags = [(i, c) for i, c in ((i, _terms(t)) for i, t in docs) if c]
    n_docs, length = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in bags:
            m = 25 + 75 * c.total() * n_docs // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in _terms(text).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def _tables():
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "UPPER", "upper", "x1"]
    draw = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, draw(r.randrange(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)] + [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,"), (2003, draw(30_000)), (2004, "w1," * 50)]
    items = [(i, draw(r.randrange(1, 25))) for i in range(30)] + [(77, docs[3][1]), (78, ""), (79, None), (80, "unknown words"), (1, draw(4)), (None, "w2 W2"), (81, "w9"), (81, "w9")]
    return docs, items


@pytest.mark.parametrize("small", [{}, {"BLOCK": 64, "LEAF": 2}, {"ITEM_BYTES": 300, "BLOCK": 100, "LEAF": 5}])
def test_rank(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = _tables()
    d = spark.createDataFrame([(*x, "s", 1.0, 2) for x in docs], "doc_id bigint, text string, item_id string, score double, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    got = sorted((tuple(r) for r in lexical_search.rank(d, q).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.rank(d, q).collect() == []
    some = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert lexical_search.rank(some, q.where("false")).collect() == [] and lexical_search.rank(some, q).count() == 1


def test_slices(monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE", 7)
    text = "Ab cde,fgh ijklmnopqrstu v w é"
    assert Counter(t for some in lexical_search.terms(text.encode()) for t in some) == Counter(t.encode() for t in _terms(text).elements())


def test_bounds_leave_subtrees_out():
    """A rare term's documents are found without visiting all leaves, and nodes stay few."""
    r = np.random.default_rng(0)
    rows = [np.unique(np.append(r.geometric(0.08, 30) % 400, [400] * (i == 777)).astype(np.int64)) for i in range(2000)]
    offsets = np.append(0, np.cumsum([len(x) for x in rows]))
    ranks = np.concatenate(rows)
    tree = Tree(np.arange(2000), np.full(2000, 100), offsets, ranks, np.ones(len(ranks), np.int64), 401)
    leaves = sum(c is None for c in tree.children)
    assert leaves < 2 * 2000 / lexical_search.LEAF + 64
    best: list = []
    visited = tree.search(np.array([400]), np.array([9]), best, 1, np.full(401, -1))
    assert [-i for _, i in best] == [777] and visited < leaves / 4
