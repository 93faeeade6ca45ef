"""Phrases of documents as arrays: what moves, slices, documents in several rows."""

import random

import pyarrow as pa
import pytest

from millrace.operators import keyphrase as K
from millrace.operators import phrases as P

TEXTS = [
    (1, "Spark runs jobs. Spark runs big data jobs on clusters. Big data jobs need 3 clusters, mid-size ones!"),
    (2, "The cost of the NASA run is high. NASA paid; the state of the art was 2.5 times Cheaper."),
    (3, None),
    (4, ""),
    (5, "Один день. Два дня и Москва; х2 день — Москва."),
    (6, "..."),
    (7, "The cost of the NASA run is high."),
]
SCHEMA = "doc_id bigint, text string"


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning("), "Join" in plan


def test_scores_move_texts_alone(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    assert moves(K.phrase_scores(docs)) == (1, False)
    rows = {(r["doc_id"], r["key"]): r for r in K.phrase_scores(docs.union(spark.createDataFrame([(None, "no id")], SCHEMA))).collect()}
    assert (2, "state of the") not in rows and (1, "spark runs jobs") in rows and all(d for d, _ in rows)
    assert rows[2, "cost"]["tf"] == 1 and rows[1, "big data jobs"]["tf"] == 2 and rows[1, "big data jobs"]["surface"] == "big data jobs"
    assert (1, "need 3 clusters") not in rows and (5, "х2") not in rows and (5, "москва") in rows


def arrays(rows):
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t or ""} for i, t in rows[at : at + 2]]) for at in range(0, len(rows), 2)]
    out = []
    for x in P.slices(iter(batches)):
        for found in P.scored(x, K.STOPWORDS):
            keys = x.text(found.runs, lower=True).to_pylist()
            out += [(x.ids[d], k, n, round(s, 9)) for d, k, n, s in zip(x.of[found.runs.last].tolist(), keys, found.runs.tf.tolist(), found.s.tolist(), strict=True)]
    return sorted(out)


def test_slices(monkeypatch):
    """However small a slice is, its documents are whole, those of several rows too."""
    rows = [*TEXTS, (7, "Another run of NASA is high."), (7, None), (8, "big data")]
    whole = arrays(rows)
    monkeypatch.setattr(P, "SLICE", 1)
    assert arrays(rows) == whole
    assert {(k, n) for d, k, n, _ in whole if d == 7} >= {("nasa", 2), ("high", 2), ("another run", 1)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similar():
    r = random.Random(5)
    both = {True: 0, False: 0}
    for _ in range(3_000):
        a = "".join(r.choice("ab") for _ in range(r.randint(1, 40)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "c"])
        b, most = "".join(b) or "a", r.choice([0.9, 0.8, 0.5])
        alike = a == b or 1 - edits(a, b) / max(len(a), len(b)) > most
        assert P.similar(a, b, most) == alike
        both[alike] += 1
    assert min(both.values()) > 500


def test_best_phrases(spark):
    docs = spark.createDataFrame([*TEXTS, (8, "Tests, cases, Tests; configurations and configuration.")], SCHEMA)
    assert moves(K.key_phrases(docs)) == (1, False)
    found = K.key_phrases(docs, top=1_000, dedup=0.9).collect()
    scores = {(r["doc_id"], r["surface"]): r["s"] for r in K.phrase_scores(docs).collect()}
    for r in found:
        assert r["score"] == pytest.approx(scores[r["doc_id"], r["phrase"]], abs=1e-11)
    own = sorted((r["rank"], r["score"], r["phrase"]) for r in found if r["doc_id"] == 8)
    assert [r[0] for r in own] == list(range(1, len(own) + 1)) and [r[1] for r in own] == sorted(r[1] for r in own)
    assert len([p for _, _, p in own if p.startswith("config") and " " not in p]) == 1  # of two with an edit in 14 letters the better one
    assert len(K.key_phrases(docs, top=2).where("doc_id = 8").collect()) == 2


def test_counts_of_all_documents(spark):
    docs = spark.createDataFrame([*TEXTS, (None, "Big data. BIG data, data"), (9, "2nd data")], SCHEMA)
    rows = P.dealt(docs)._jdf.queryExecution().executedPlan().toString()
    assert rows.count("Exchange hashpartitioning(doc_id") == 1
    assert moves(K.phrase_counts(docs)) == (2, False)  # texts, then counts by phrase
    found = {(r["n"], r["key"]): (r["docs"], r["tf"]) for r in K.phrase_counts(docs).collect()}
    assert found[2, "big data"] == (2, 4) and found[1, "data"] == (3, 6) and found[3, "the nasa run"] == (2, 2)
    assert not {(1, "2nd"), (2, "2nd data"), (2, "data data"), (1, "3")} & set(found)
