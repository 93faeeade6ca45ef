"""A folder of records: read in partitions, pushed filters, writes that commit or leave things as they were."""

import os

import pytest

from millrace.sources import folder


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(folder.Records)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def _write(spark, rows, path, mode="append", parts=3):
    spark.createDataFrame(rows, "name string, size bigint, content string").repartition(parts).write.format("records").mode(mode).save(path)


def _read(spark, path):
    return spark.read.format("records").load(path)


def test_round_trip(source, tmp_path):
    path = str(tmp_path / "s")
    assert _read(source, path).collect() == []
    _write(source, [(f"r{i}.json", None, f"é{i}") for i in range(20)] + [("empty", None, None)], path)
    assert {r["name"]: r["content"] for r in _read(source, path).collect()} == {f"r{i}.json": f"é{i}" for i in range(20)} | {"empty": ""}
    _write(source, [("r3.json", None, "new"), ("more", None, "x")], path)
    assert {r["name"]: r["content"] for r in _read(source, path).where("name in ('r3.json', 'r4.json', 'more')").collect()} == {"r3.json": "new", "r4.json": "é4", "more": "x"}
    assert sorted(os.listdir(path)) == sorted([*(f"r{i}.json" for i in range(20)), "empty", "more"])
    _write(source, [("only", None, "o")], path, "overwrite")
    assert [tuple(r) for r in _read(source, path).collect()] == [("only", 1, "o")]


def test_filters_are_pushed(source, tmp_path):
    path = str(tmp_path / "s")
    _write(source, [(f"{k}{i}", None, k) for k in "ab" for i in range(5)], path)
    os.chmod(f"{path}/a1", 0)
    for condition, n in (("name = 'b2'", 1), ("name in ('b1', 'b9', 'a3')", 2), ("name like 'b%'", 5), ("name like 'b%' and content = 'b' and name = 'b0'", 1), ("name = 'b1' and name = 'b2'", 0)):
        reader = folder.Reader(path)
        frame = _read(source, path).where(condition)
        assert frame.count() == n
        assert reader.partitions()[0].names[0][0] == "a0"
    reader = folder.Reader(path)
    left = list(reader.pushFilters([folder.StringStartsWith(("name",), "b"), folder.EqualTo(("content",), "b"), folder.In(("name",), ("b1", "a1"))]))
    assert left == [folder.EqualTo(("content",), "b")] and [n for n, _ in reader.partitions()[0].names] == ["b1"]


def test_partitions_by_size(source, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    _write(source, [(f"f{i}", None, "x" * 3000) for i in range(10)], path)
    monkeypatch.setattr(folder, "PARTITION", 20_000)
    assert [len(p.names) for p in folder.Reader(path).partitions()] == [3, 3, 3, 1]


def test_aborted_write_leaves_the_old_files(source, tmp_path):
    path = str(tmp_path / "s")
    _write(source, [("a", None, "old"), ("b", None, "old")], path)
    for bad in ("../out", ".hidden", None, ""):
        with pytest.raises(Exception, match="no name of a record"):
            _write(source, [("a", None, "new"), ("c", None, "new"), (bad, None, "x")], path)
    with pytest.raises(Exception, match="written twice"):
        _write(source, [("a", None, "new"), ("d", None, "1"), ("d", None, "2")], path)
    assert {r["name"]: r["content"] for r in _read(source, path).collect()} == {"a": "old", "b": "old"}
    assert sorted(os.listdir(path)) == ["a", "b"] and os.listdir(tmp_path) == ["s"]
