"""The stored index: build, read back, entries that are out of date."""

from millrace.operators import index as I
from millrace.operators.chunking import chunk_text

FILES = "path string, mtime bigint, size bigint, text string"


def test_build_and_load(spark, tmp_path):
    long = "word " * 300
    docs = spark.createDataFrame([("a/1", 1, 1500, long), ("a/2", 1, 0, ""), ("a/3", 1, 3, None), ("b/1", 1, 5, "Hello")], FILES)
    tools = spark.createDataFrame([("a/1", 7, 4, "tool")], FILES)
    disk = I.together({"projects": docs, "tools": tools})
    path = str(tmp_path / "index")
    I.build(disk, path)
    rows = I.load(spark, path, disk).collect()
    assert {(r["corpus"], r["path"]) for r in rows} == {("projects", "a/1"), ("projects", "b/1"), ("tools", "a/1")}
    found = sorted((r["idx"], r["chunk"], r["start_byte"], r["end_byte"]) for r in rows if (r["corpus"], r["path"]) == ("projects", "a/1"))
    assert found == [(i, *c) for i, c in enumerate(chunk_text(long))] and len(found) > 2
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in rows)
    changed = I.together({"projects": docs.withColumn("mtime", docs.mtime + 1), "tools": tools})
    assert {(r["corpus"], r["path"]) for r in I.load(spark, path, changed).collect()} == {("tools", "a/1")}


def test_empty(spark, tmp_path):
    none = I.together({"projects": spark.createDataFrame([], FILES), "tools": spark.createDataFrame([("a", 1, 1, "x")], FILES)})
    I.build(none, str(tmp_path / "index"))
    assert [r["path"] for r in I.load(spark, str(tmp_path / "index"), none).collect()] == ["a"]


def _files(spark, rows):
    return spark.createDataFrame([("projects", *r) for r in rows], "corpus string, " + FILES)


def _state(store):
    return {(r["path"], r["mtime"]) for r in store.rows().collect()}


def test_sync_in_rounds(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "i"), buckets=8)
    assert store.version == 0 and store.rows().collect() == [] and store.valid(_files(spark, [])).collect() == []
    first = [(f"f{i}", 1, 4, "text") for i in range(40)] + [("bad", 1, 3, None)]
    assert store.sync(_files(spark, first)) == 1
    before = {r["bucket"]: r["version"] for r in store.written().collect()}
    assert set(before.values()) == {1} and len(before) > 4
    second = [("f0", 2, 5, "other"), *first[2:-1], ("new", 1, 3, "abc")]
    found = {(r["path"], r["was"], r["is"]) for r in store.differences(_files(spark, second)).collect()}
    assert found == {("f0", True, True), ("f1", True, False), ("new", False, True)}
    assert store.sync(_files(spark, second)) == 2
    assert _state(store) == {(p, m) for p, m, *_ in second}
    changed = spark.createDataFrame([("projects", p) for p in ("f0", "f1", "new")], "corpus string, path string")
    touched = {r[0] for r in changed.select(I.bucket_of(changed.corpus, changed.path, 8)).collect()}
    after = {r["bucket"]: r["version"] for r in store.written().collect()}
    assert {b for b, v in after.items() if v == 2} <= touched and all(after[b] == 1 for b in before if b not in touched)
    assert store.sync(_files(spark, second)) == 2, "nothing changed, nothing is written"
    assert store.sync(_files(spark, [])) == 3 and store.rows().collect() == []
    assert store.sync(_files(spark, second)) == 4 and len(store.vacuum()) == 3 and _state(store) == {(p, m) for p, m, *_ in second}


def test_lost_before_publishing(spark, tmp_path, monkeypatch):
    import pytest

    store = I.Store(spark, str(tmp_path / "i"))
    store.sync(_files(spark, [("a", 1, 1, "x")]))
    with monkeypatch.context() as m:
        m.setattr(I.Store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.sync(_files(spark, [("b", 1, 1, "y")]))
    assert store.version == 1 and _state(store) == {("a", 1)}
    manifest = store._manifest()
    store.sync(_files(spark, [("b", 1, 1, "y")]))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(manifest | {"version": 2})
    assert _state(store) == {("b", 1)}


def test_nothing_at_all(spark, tmp_path):
    none = spark.createDataFrame([], "corpus string, " + FILES)
    I.build(none, str(tmp_path / "i"))
    assert I.load(spark, str(tmp_path / "i"), none).collect() == []


def test_stream(spark, tmp_path):
    import os

    from millrace.streaming.index import maintain

    schema = "corpus string, path string, op string, at bigint, mtime bigint, size bigint, text string"
    put = lambda rows: spark.createDataFrame([("projects", *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    store = I.Store(spark, str(tmp_path / "i"))
    put([("a", "write", 1, 1, 1, "x"), ("a", "write", 3, 3, 1, "z"), ("a", "write", 2, 2, 1, "y"), ("b", "write", 1, 1, 1, "b"), ("c", "write", 1, 1, 1, "c"), ("c", "remove", 2, 1, 1, "c")])
    run()
    assert _state(store) == {("a", 3), ("b", 1)} and store.version == 1
    put([("b", "remove", 5, 1, None, None), ("d", "write", 5, 7, 1, "d")])
    run()
    assert _state(store) == {("a", 3), ("d", 7)} and store.version == 2
    for name in ("1", ".1.crc"):  # as if the stream had been lost after the version, before its own commit
        if os.path.exists(tmp_path / "c" / "commits" / name):
            os.remove(tmp_path / "c" / "commits" / name)
    run()
    assert _state(store) == {("a", 3), ("d", 7)} and store.version == 2
    put([("d", "write", 9, 9, 1, "e")])
    run()
    assert _state(store) == {("a", 3), ("d", 9)} and store.version == 3


def test_vectors_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Texts are dealt to buckets, and rows that stay are written from where they lie."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    store = I.Store(spark, str(tmp_path / "i"), buckets=2)
    count = lambda: len(store.rows().inputFiles())
    files: list = []
    counts = []
    for n in range(1, 7):
        files += [(f"f{n}-{i}", n, 4, "text") for i in range(4)]
        store.sync(_files(spark, files))
        store.vacuum()
        counts.append(count())
    assert _state(store) == {(p, m) for p, m, *_ in files} and max(counts) <= 4 * 2 + 4
    assert "Exchange" not in plans[0][: plans[0].index("MapInArrow")], "no exchange above the chunks"
    assert [p.count("REBALANCE") for p in plans[:2]] == [1, 1]
    monkeypatch.setattr(I, "FEW", 0)  # as if too many files had changed for a broadcast
    store.sync(_files(spark, files[1:]))
    assert _state(store) == {(p, m) for p, m, *_ in files[1:]} and plans[-1].count("REBALANCE") == 2


def test_query_keeps_one_version(spark):
    import pathlib

    from millrace.jobs import registry
    from tests.conftest import SF

    df = registry.queries()["index_sync"](spark, SF)
    root = df.inputFiles()[0].removeprefix("file://").split("/data/")[0]
    named = {f"{f}/bucket={b}" for b, f in I.Store(spark, root)._manifest()["folders"].items()}
    assert {f"{p.parent.name}/{p.name}" for p in pathlib.Path(root, "data").glob("*/bucket=*")} == named and df.count() > 0
