"""Files and streams."""

import os

from pyspark.sql import functions as F

from millrace.functions.paths import parse_ignore
from millrace.sources import files
from millrace.streaming import board
from tests.conftest import SF


def test_files(spark, tmp_path):
    (tmp_path / "a" / "target").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("---\nname: x\ndescription: d\n---\nbody")
    (tmp_path / "a" / "target" / "y.md").write_text("ignored")
    (tmp_path / "empty").write_text("")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x80")
    found = files.scan(spark, str(tmp_path), parse_ignore("target"))
    assert {r["path"] for r in found.collect()} == {"a/x.md", "bad.bin"}
    texts = files.texts(found)
    assert [r["path"] for r in texts.collect()] == ["a/x.md"]
    assert [tuple(r) for r in files.knowledge(texts).collect()] == [("x", "d", "body")]
    assert files.snapshot(found).columns == ["path", "mtime", "size"]


def test_skills_words_logs(spark, tmp_path):
    text = "FOR: do things\nAGENT: me\nENTITIES: Foo, bar\nSTATS: success=3 fail=1\nINSTRUCTION:\nrun it\nFOR: not a header\nTOOL_CALLS: [{\"name\":\"t\",\"arguments\":{}}]"
    s = files.skills(spark.createDataFrame([("s/demo.md", text)], ["path", "text"])).first()
    assert (s["skill_file"], s["agent_name"], s["description"], s["entities"], s["success_count"], s["fail_count"]) == ("demo.md", "me", "do things", ["foo", "bar"], 3, 1)
    assert s["prompt"].startswith("run it") and s["tool_calls"][0]["name"] == "t"
    (tmp_path / "w.dic").write_text("3\nRunning/X\ncats\n\n")
    assert {r["stem"] for r in files.word_list(spark, str(tmp_path / "w.dic")).collect()} == {"runn", "cat"}
    (tmp_path / "l.log").write_text("[10:11:12] user: hello: you\nnoise\n")
    assert [tuple(r) for r in files.logs(spark, str(tmp_path / "l.log")).collect()] == [("10:11:12", "user", "hello: you")]


def _stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    return board.events_log(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")))


def _run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_task_states(spark, tmp_path):
    _run(board.task_states(_stream(spark, tmp_path), timeout=10**9), "states", "update")
    batch = board.events_log(spark.read.parquet(f"{SF}/events.parquet"))
    order = F.struct(F.unix_timestamp("event_time"), "event_id")
    expected = {r[0]: r[1] for r in batch.groupBy("task_id").agg(F.max_by("status", order)).collect()}
    last = {r["task_id"]: r["status"] for r in spark.sql("SELECT * FROM states WHERE reason = 'event'").collect()}
    assert last == expected


def test_usage(spark, tmp_path):
    _run(board.usage(_stream(spark, tmp_path)), "usage", "complete")
    batch = board.usage(board.events_log(spark.read.parquet(f"{SF}/events.parquet")))
    assert sorted(map(tuple, spark.table("usage").collect())) == sorted(map(tuple, batch.collect()))


def test_package_without_llm():
    """Nothing outside of the subpackage names it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "millrace")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
