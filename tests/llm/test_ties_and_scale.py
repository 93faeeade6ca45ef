"""Rows that tie, and an index fitted on a small part of what it holds."""

import numpy as np
import pytest

from millrace.llm import ann, mixing, near_dup


def test_mix_of_repeated_and_missing_ids(spark):
    """Rows without an id, with one id for different texts, and equal rows: each source comes near its target."""
    rows = [(None, "w " * (5 + i % 7), "a") for i in range(400)]
    rows += [(7, "x " * (3 + i), "b") for i in range(60)]
    rows += [(9, "same words here", "c")] * 500
    rows += [(i, "y " * 20, "d") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5).cache()
    taken: dict = {}
    for r in mixing.takes(docs).collect():
        taken.setdefault((r["source_size"], r["target"]), []).append((r["size"], r["taken"]))
        assert r["taken"] <= 2 * r["size"]
    assert len(taken) == 4
    for (_, target), found in taken.items():
        assert abs(sum(t for _, t in found) - target) <= max(s for s, _ in found)
    mixed = mixing.mix(docs).withColumn("n", mixing.word_count(docs.text)).groupBy("source").agg({"n": "sum"}).collect()
    assert sorted(r[1] for r in mixed) == sorted(sum(t for _, t in found) for found in taken.values())


def test_first_of_equal_words_is_told_by_the_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "s2"), (1, text, "s0"), (1, "One  two three four five six seven eight", "s1"), (2, "other words are here now", None)]
    for n in (1, 3, 7):
        kept = near_dup.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(n, "source")).collect()
        assert sorted(tuple(r) for r in kept if r["doc_id"] == 1) in ([(1, text, "s0")], [rows[2], (1, text, "s0")])
        assert (2, rows[3][1], None) in {tuple(r) for r in kept}


@pytest.mark.parametrize("kind", ["lengths", "gauss", "clusters"])
def test_recall_beyond_the_sample(spark, kind):
    """50,000 vectors, an index of 1,000 of them: recall among all vectors stays at 0.95."""
    r = np.random.default_rng(3)
    n, d = 50_000, 32
    x = r.standard_normal((n, d))
    if kind == "lengths":
        x *= r.lognormal(0, 0.6, (n, 1))
    if kind == "clusters":
        x = r.standard_normal((500, d))[r.integers(0, 500, n)] + 0.1 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(8)
    found: dict = {}
    for row in ann.search(df, every=200, sample=1000).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for q in range(0, n, 200):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits / (20 * (n // 200)) >= 0.95


def test_templates_longer_than_a_block(spark):
    """A template of 120 words is found, wherever it stands among others."""
    from millrace.llm import license_join

    words = [f"w{i}" for i in range(120)]
    templates = (("long", " ".join(words), "w7"), *license_join.TEMPLATES)
    texts = [" ".join(["x"] * n + words + ["y"] * 50) for n in (0, 60, 119, 500)] + [" ".join(words[:90]), "released under the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["labels"] for r in license_join.scan(docs, templates).orderBy("doc_id").collect()]
    assert got == ["long"] * 4 + ["", "mit"] and license_join.spans() == (license_join.SPAN, license_join.STEP)


def test_ids_beyond_two_bytes():
    from millrace.llm import packing

    class Wide:
        max_token_value = 99_999

        @staticmethod
        def encode_to_numpy(text, allowed_special):
            return np.array([70_000 + len(text)], np.uint32)

    assert packing.token_ids(Wide, "abc").tolist() == [70_003, packing.CLOSING]


def test_matrix_of_frequent_terms_is_bounded(monkeypatch):
    """Neighbours are the same, however many terms are in the matrix."""
    from millrace.llm import toxicity

    r = np.random.default_rng(1)
    example = np.repeat(np.arange(200), 20)
    bucket = np.minimum(r.geometric(0.05, 4000), 90)
    keys, first = np.unique(example * 100 + bucket, return_index=True)
    example, bucket = keys // 100, keys % 100
    weight = r.random(len(keys))
    weight /= np.sqrt(np.bincount(example, weight * weight))[example]
    found = []
    for most in (4096, 5, 0):
        monkeypatch.setattr(toxicity, "DENSE", most)
        index = toxicity.build_index(np.ones(100), np.arange(200), np.arange(200) % 2, (example, bucket, weight))
        assert len(index.matrix) <= most
        found.append([index.ids[toxicity.nearest(index, bucket[example == e], weight[example == e], 15)[0]].tolist() for e in range(0, 200, 17)])
    assert found[0] == found[1] == found[2]


def test_samples_keep_rare_labels(spark):
    """One low label in 500: a sample of 1,200 of 60,000 holds a hundred of them, and weights restore the shares."""
    from millrace.llm.common import weighted_sample

    labels = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 500 = 3 THEN 0 ELSE 1 END AS y").cache()
    got = {r["y"]: (r["n"], r["w"]) for r in weighted_sample(labels, 1200, 5).groupBy("y").agg({"weight": "sum", "*": "count"}).toDF("y", "w", "n").collect()}
    assert 60 <= got[0][0] <= 120 and 1000 < got[1][0] < 1400
    assert abs(got[0][1] / (got[0][1] + got[1][1]) - 1 / 500) < 1e-3
    even = weighted_sample(labels.where("y = 1 OR doc_id < 6000"), 100_000, 5)
    assert even.count() == labels.where("y = 1 OR doc_id < 6000").count() and even.select("weight").distinct().collect() == [(1.0,)]
    assert weighted_sample(labels.where("y > 1"), 10, 5).collect() == []


def test_priors_follow_weights():
    """A class sampled five times as densely, with weights: scores as of the whole."""
    from millrace.llm import quality_qda

    r = np.random.default_rng(0)
    x = np.concatenate([r.standard_normal((4000, 3)), r.standard_normal((400, 3)) + 1.5])
    y = np.repeat([1, 0], [4000, 400])
    whole = quality_qda.fit(x, y)
    some = np.concatenate([np.arange(0, 4000, 5), np.arange(4000, 4400)])
    part = quality_qda.fit(x[some], y[some], weight=np.where(y[some] == 1, 5.0, 1.0))
    score = lambda m: 1 / (1 + np.exp(-(m.slope * quality_qda.log_ratio(m, x) + m.offset)))
    assert np.abs(score(whole) - score(part)).mean() < 0.03 and abs(score(part).mean() - 4000 / 4400) < 0.03


def test_lists_are_scanned_for_all_their_queries():
    """Whole distances where the test keeps a list, infinite where a query doesn't want it; a self-made far list is left after a block."""
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 33))
    x[300:] += 40.0
    edges, queries = np.array([0, 100, 200, 300, 400]), r.standard_normal((30, 33))
    wanted = [[0, 1, 3] if i % 2 else [2, 0] for i in range(30)]
    found = ann.scan(x, edges, queries, wanted, 20)
    whole = ((queries[:, None] - x) ** 2).sum(axis=2)
    for i, lists in enumerate(wanted):
        inside = np.concatenate([np.arange(edges[w], edges[w + 1]) for w in lists])
        assert np.isinf(np.delete(found[i], inside)).all() and np.isinf(found[i][300:]).all()
        near = inside[np.argsort(whole[i][inside])[:20]]
        assert np.allclose(found[i][near], whole[i][near])
    few = ann.scan(x[:15], np.array([0, 15]), queries[:1], [[0]], 20)
    assert np.allclose(few, whole[:1, :15])
