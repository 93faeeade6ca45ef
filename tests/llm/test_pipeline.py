"""The pipeline and the registered queries over the smallest tables."""

import collections

import corpus_pipeline
from millrace.llm import entry, langid, near_dup
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, SF).cache()
    scored = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in scored.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    first = corpus_pipeline.near_dedup(spark, kept, SF).cache()
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == set(brute.classes(texts).values())
    left = {r["doc_id"]: r["text"] for r in first.collect()}
    cut = corpus_pipeline.passage_dedup(spark, first, SF).cache()
    sizes = brute.repeated_bytes(left)
    for r in cut.collect():
        n, removed, spans, _ = sizes[r["doc_id"]]
        assert 0 <= n - removed - len(r["text"].encode()) <= 6 * spans
    mixed = corpus_pipeline.source_mixing(spark, cut, SF).cache()
    assert mixed.columns == columns and max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    pieces = corpus_pipeline.sequence_packing(spark, mixed, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.collect()}


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "passage_dedup", "source_mixing", "sequence_packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_queries(spark):
    found = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, f in found.items():
        df = f(spark, SF)
        n = df.count()
        if name.startswith(("op7_", "op10_", "op11_", "op13_")):
            assert n > 0 or name.startswith("op13_")
        else:
            assert n == documents, name
    assert near_dup.LEAST == 0.8


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id bigint, size int, score double, rank int, target string, list int"


def test_stages_on_hard_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, ties, columns with the operators' own names."""
    words = "the cat sat on the mat and looked at a dog in the garden where many other animals had been seen before noon".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] for j in range(60 + i % 9))
    rows = [(i if i % 6 else None, text(i % 40), "en" if i % 4 else None, ("a", None, "b")[i % 3], 5, 1, 2, 0.5, 3, "t", 4) for i in range(120)]
    rows += [(7, text(3), "en", "a", 5, 1, 2, 0.5, 3, "t", 4)] * 4 + [(8, None, "en", "a", 5, 1, 2, 0.5, 3, "t", 4), (9, "", None, None, 5, 1, 2, 0.5, 3, "t", 4), (10, "123 !!", "en", "a", 5, 1, 2, 0.5, 3, "t", 4)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() > 0, name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_on_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
