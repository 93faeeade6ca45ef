"""Search within keys, and names in texts, against brute force."""

import random

import numpy as np
import pytest

from millrace.operators import mentions as M
from millrace.operators import vectors as V


@pytest.mark.parametrize("small", [{}, {"BLOCK": 3, "PART": 16, "STEP": 2}])
def test_knn_by_key(spark, monkeypatch, small):
    """A hot key, small keys, ties by equal vectors, a null key; more asked than there is."""
    for name, value in small.items():
        monkeypatch.setattr(V, name, value)
    r = np.random.default_rng(2)
    x = r.standard_normal((150, 6))
    x[20:30] = x[19]
    keys = ["hot" if i % 3 else ("a", "b", None, "one")[i % 4] for i in range(150)]
    e = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, keys, strict=True))], "vec_id bigint, embedding array<double>, key string").withColumnRenamed("key", "project")
    got = sorted(tuple(t) for t in V.knn(e, e.where("vec_id % 4 = 0"), 7, by="project").select("project", "query_id", "rank", "vec_id", "dist").collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = []
    for q in range(0, 150, 4):
        near = sorted((round(1 - float(unit[q] @ unit[i]), 6), i) for i in range(150) if i != q and keys[i] is not None and keys[i] == keys[q])[:7]
        expected += [(keys[q], q, rank, i, pytest.approx(d, abs=2e-6)) for rank, (d, i) in enumerate(near, 1)]
    assert got == sorted(expected, key=lambda t: t[:4]) and len(got) > 150
    whole = V.knn(e, e.where("vec_id % 50 = 0"), 3).collect()
    assert {t["query_id"] for t in whole} == {0, 50, 100} and "project" not in V.knn(e, e, 3).columns
    assert V.knn(e.where("false"), e, 3, by="project").collect() == []


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_mentions_by_shards(spark, monkeypatch, size):
    monkeypatch.setattr(M, "SHARD_BYTES", size)
    r = random.Random(1)
    names = [None, "é", "日本", "x" * 50] + ["".join(r.choices("abc", k=r.randrange(1, 6))) for _ in range(60)]
    texts = [None, "", "é日本語", "x" * 120] + ["".join(r.choices("abcd ", k=r.randrange(60))) for _ in range(40)]
    texts += texts[5:9]
    t = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    found = M.mentions(t, spark.createDataFrame([(x,) for x in names], "name string"))
    keys = {bytes(row[1]): row[0] for row in t.select("text", M.text_key(t.text)).where("text is not null").collect()}
    got = sorted((keys[bytes(f["key"])], f["name"], f["n"]) for f in found.collect())
    known = [x for x in texts if x is not None]
    assert got == sorted((x, n, known.count(x)) for x in set(known) for n in set(names) - {None} if n in x)
    everywhere = M.mentions(t, spark.createDataFrame([("",)], "name string")).collect()
    assert {keys[bytes(f["key"])] for f in everywhere} == set(known)
