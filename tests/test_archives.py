"""Nested archives and running sums against walking them."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import archives as A
from millrace.operators import running as R

NODES = "conv_id bigint, turn bigint, parent bigint, place bigint, archived boolean"


def _forest(r, conv, n, depth):
    rows, inner = [], set()
    for turn in range(n):
        around = [t for t in range(max(0, turn - depth), turn)]
        parent = r.choice(around) if around and r.random() < 0.8 else None
        inner.add(parent)
        rows.append([conv, turn, parent, r.randrange(5)])
    return [(*row, row[1] in inner or r.random() < 0.1) for row in rows]


def _children(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[3], x[1])):
        out.setdefault(row[2], []).append(row)
    return out


def _flat(children, row):
    return [row] if not row[4] else [x for c in children.get(row[1], []) for x in _flat(children, c)]


def brute_all(rows):
    children = _children(rows)
    return [(x[1], x[2] is not None) for top in children.get(None, []) for x in _flat(children, top)]


def brute_last(rows):
    children = _children(rows)
    tail = children.get(None, [])
    at = [i for i, x in enumerate(tail) if x[4]]
    if not at:
        return [(x[1], False) for x in tail]
    return [(x[1], False) for x in tail[: at[-1]]] + [(x[1], True) for x in children.get(tail[at[-1]][1], [])] + [(x[1], False) for x in tail[at[-1] + 1 :]]


def depth_of(rows, row):
    by = {x[1]: x for x in rows}
    return 0 if row[2] is None else 1 + depth_of(rows, by[row[2]])


def test_forests(spark):
    r = random.Random(6)
    convs = {c: _forest(r, c, n, d) for c, n, d in ((1, 120, 2), (2, 60, 40), (3, 1, 1), (4, 30, 1), (5, 90, 5))}
    nodes = spark.createDataFrame([x for rows in convs.values() for x in rows], NODES).repartition(3).cache()
    for f, brute in ((A.unfreeze_all, brute_all), (A.unfreeze_last, brute_last)):
        got = sorted(tuple(x) for x in f(nodes).collect())
        assert got == sorted((c, i, *x) for c, rows in convs.items() for i, x in enumerate(brute(rows)))
    sizes = {x["conv_id"]: (x["hidden"], x["depth"]) for x in A.archive_len(nodes).collect()}
    assert sizes == {c: (sum(x[2] is not None for x in rows), max(depth_of(rows, x) for x in rows)) for c, rows in convs.items()}
    assert A.unfreeze_all(nodes.where("false")).collect() == [] and A.unfreeze_last(nodes.where("false")).collect() == []


def test_deep_chain_without_recursion_limit(spark):
    """A chain of 3,000 turns: twelve rounds, whatever limit recursion has."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        n = 3000
        chain = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("bigint").alias("place"), (F.col("id") < n - 1).alias("archived"))
        assert [tuple(x) for x in A.archive_len(chain).collect()] == [(1, n - 1, n - 1)]
        assert [tuple(x) for x in A.unfreeze_all(chain).collect()] == [(1, 0, n - 1, True)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    loop = spark.createDataFrame([(1, 1, 2, 0, True), (1, 2, 1, 0, True)], NODES)
    with pytest.raises(ValueError, match="inside themselves"):
        A.archive_len(loop).collect()


def test_running_sums_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else r.choice(["a", None, "b"]), i * 7919 % 5000, r.randrange(9) if i % 11 else None, "x") for i in range(5000)]
    table = spark.createDataFrame(rows, "k string, o bigint, v bigint, n string").repartition(5)
    got = sorted((tuple(x) for x in R.running(table, ["k"], ["o"], {"s": F.col("v"), "n_so_far": F.lit(1)}, pieces=13).collect()), key=repr)
    expected, sums = [], {}
    for k, o, v, n in sorted(rows, key=lambda x: x[1]):
        s, c = sums.get(k, (0, 0))
        sums[k] = s + (v or 0), c + 1
        expected.append((k, o, v, n, *sums[k]))
    assert got == sorted(expected, key=repr)
    held = [x[0] for x in R.ranges(table, ["k"], ["o"], 13).where("k = 'hot'").groupBy("piece").count().select("count").collect()]
    assert len(held) > 6 and max(held) < 1000, "the hot key is dealt to several ranges"
    parts = R.parts(table, ["k"], ["o"], F.col("o"), 100, 13)
    by = {}
    for x in parts.collect():
        by.setdefault(x["k"], {})[x["part"]] = x["items"]
    for k in {x[0] for x in rows}:
        assert [o for p in sorted(by[k]) for o in by[k][p]] == sorted(x[1] for x in rows if x[0] == k) and all(len(i) == 100 for p, i in by[k].items() if p < max(by[k]))
