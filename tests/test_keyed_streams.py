"""Keyed streams: stacks and fragments against the batch, with timers that fire."""

import datetime
import random

import pytest

from millrace.operators import fragments
from millrace.streaming import board, keyed

EPOCH = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A file stream that is fed batch by batch and keeps its checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make = spark, folder, schema, make

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/c").trigger(availableNow=True).start(f"{self.folder}/out")
        query.awaitTermination()

    def out(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


def test_stack_of_waiting_parents(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "session_id string, event_time timestamp, seq bigint, op string, task_id string", lambda s: keyed.waiting(s, ttl=100))
    feed.put([("s", at(1), 1, "push", "a"), ("s", at(2), 2, "push", "b"), ("t", at(2), 3, "push", "x"), ("u", at(2), 4, "pop", None)])
    assert feed.out() == [("u", None, "empty", 0)]
    feed.put([("s", at(4), 6, "push", "c"), ("s", at(3), 5, "pop", None), ("s", at(5), 7, "pop", None)])
    assert feed.out() == sorted([("u", None, "empty", 0), ("s", "b", "popped", 1), ("s", "c", "popped", 1)], key=repr)
    feed.put([("v", at(90), 8, "push", "later")])
    assert len(feed.out()) == 3
    feed.put([("v", at(150), 9, "push", "last")])  # the time of a and x is over, that of v's isn't
    feed.put([("w", at(151), 10, "pop", None), ("s", at(151), 11, "pop", None)])
    found = feed.out()
    assert ("s", "a", "expired", 0) in found and ("t", "x", "expired", 0) in found and ("s", None, "empty", 0) in found
    assert sum(f[2] == "expired" for f in found) == 2
    feed.put([("v", at(152), 12, "pop", None)])
    assert ("v", "last", "popped", 1) in feed.out()


FRAGMENTS = "stream string, event_time timestamp, seq bigint, idx int, id string, name string, arguments string, last boolean"


def _fragments():
    r = random.Random(8)
    rows = []
    for s in range(12):
        n = r.randrange(1, 9)
        for i in range(n):
            idx = r.randrange(3)
            rows.append((f"s{s}", at(s), i, idx if i < n - 1 or n == 1 else None, f"id{idx}" if r.random() < 0.4 else None, r.choice(["", "f", None]), f"{i},", i == n - 1))
    rows += [("open", at(5), 0, 0, "i", "f", "{", False), ("open", at(5), 2, 0, None, None, "}", True)]
    rows += rows[3:9]  # some come twice
    r.shuffle(rows)
    return rows


def test_fragments_out_of_order(spark, tmp_path):
    rows = _fragments()
    feed = Feed(spark, str(tmp_path), FRAGMENTS, lambda s: keyed.assembled(s, ttl=1000))
    for k in range(3):
        feed.put([(r[0], at(10 + k), *r[2:]) for r in rows[k::3]])
    batch = sorted((tuple(r) for r in fragments.assembled(spark.createDataFrame(rows, FRAGMENTS)).collect()), key=repr)
    assert [f[:5] for f in feed.out()] == batch and {f[5] for f in feed.out()} == {"whole"}
    expected = {}
    for s, _, i, idx, id_, name, arguments, _ in sorted(set(rows), key=lambda x: (x[0], x[2])):
        if s != "open" and idx is not None:
            e = expected.setdefault((s, idx), ["", "", ""])
            expected[s, idx] = [id_ or e[0], e[1] + (name or ""), e[2] + arguments]
    assert batch == sorted(((s, i, *e) for (s, i), e in expected.items()), key=repr)
    feed.put([("open", at(2000), 5, 0, None, None, None, False)])  # a late one keeps it open
    feed.put([("other", at(9000), 0, 0, "k", "g", "()", True)])
    feed.put([("more", at(9001), 0, 0, "k", "g", "()", False)])
    assert ("open", 0, "i", "f", "{}", "broken") in feed.out() and ("other", 0, "k", "g", "()", "whole") in feed.out()


def test_task_timeouts_fire(spark, tmp_path):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    schema, seen = "task_id bigint, event_time timestamp, event_id bigint, status string", []
    for rows in ([(1, at(0), 1, "in_progress"), (2, at(0), 2, "completed"), (3, at(50), 3, "in_progress")], [(4, at(100), 4, "pending")], [(4, at(101), 5, "in_progress")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = board.task_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), timeout=60).writeStream.outputMode("update")
        stream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda batch, _: seen.extend(map(tuple, batch.collect()))).start().awaitTermination()
    got = {(r[0], r[1], r[2]) for r in seen}
    assert (1, "failed", "timeout") in got and (2, "failed", "timeout") not in got and (3, "failed", "timeout") not in got
    assert (4, "in_progress", "event") in got


def test_calls_and_activity(spark, tmp_path):
    asked, done = f"{tmp_path}/asked", f"{tmp_path}/done"
    spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0))], "task_id bigint, event_time timestamp").coalesce(1).write.parquet(asked)
    results = [(1, at(30), "completed"), (2, at(500), "failed"), (9, at(1), "completed"), (3, at(-5), "failed")]
    spark.createDataFrame(results, "task_id bigint, event_time timestamp, status string").coalesce(1).write.parquet(done)
    left = spark.readStream.schema("task_id bigint, event_time timestamp").parquet(asked)
    right = spark.readStream.schema("task_id bigint, event_time timestamp, status string").parquet(done)
    q = board.calls(left, right, "5 minutes").writeStream.format("memory").queryName("answered").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["task_id"], r["status"]) for r in spark.table("answered").collect()] == [(1, "completed")]
    feed = Feed(spark, f"{tmp_path}/a", "user_id bigint, event_time timestamp", lambda s: board.activity(s, "30 minutes", "0 seconds"))
    feed.put([(1, at(0)), (1, at(600)), (1, at(4000)), (2, at(10))])
    feed.put([(3, at(20_000))])
    feed.put([(3, at(20_001))])
    stamp = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC)
    got = {(r[0], r[3], stamp(r[1].timestamp()), stamp(r[2].timestamp())) for r in feed.out()}
    assert got == {(1, 2, at(0), at(2400)), (1, 1, at(4000), at(5800)), (2, 1, at(10), at(1810))}
