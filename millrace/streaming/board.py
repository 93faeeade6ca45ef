"""The task board as a stream: state per task with timeout and eviction, counters, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.board import TERMINAL

OUT = "task_id long, status string, reason string, updated_at long, attempts long"
STATE = "status string, updated_at long, attempts long"


def task_states(log: DataFrame, timeout: int, delay: str = "0 seconds") -> DataFrame:
    """A row for each change of a task (task_id, event_time, event_id, status in): the last event wins.

    Without an event for ``timeout`` seconds of event time a running task fails, a finished one is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, updated, attempts = state.get
            state.remove()
            if status not in TERMINAL:
                yield pd.DataFrame([(key[0], "failed", "timeout", updated, attempts)], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        status, updated, attempts = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["event_time", "event_id"])
        for at, new in zip(rows["event_time"], rows["status"], strict=True):
            seconds = int(pd.Timestamp(at).timestamp())
            if seconds >= updated:
                status, updated = new, seconds
            attempts += new == "in_progress"
        state.update((status, updated, int(attempts)))
        state.setTimeoutTimestamp(max((updated + timeout) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], status, "event", updated, int(attempts))], columns=[c.split()[0] for c in OUT.split(", ")])

    marked = log.withWatermark("event_time", delay)
    return marked.groupBy("task_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def usage(log: DataFrame) -> DataFrame:
    """Running successes and failures by user, for update mode."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return log.groupBy("user_id").agg(n("completed").alias("success"), n("failed").alias("fail"))


def calls(asked: DataFrame, done: DataFrame, limit: str) -> DataFrame:
    """Requests with the results that come within ``limit``: a stream join with bounded state."""
    a = asked.select(F.col("task_id"), F.col("event_time").alias("asked")).withWatermark("asked", "1 minute")
    d = done.select(F.col("task_id").alias("done_id"), F.col("event_time").alias("done"), "status").withWatermark("done", "1 minute")
    near = F.expr(f"task_id = done_id AND done >= asked AND done <= asked + INTERVAL {limit}")
    return a.join(d, near).select("task_id", "asked", "done", "status")


def activity(log: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of users, closed after a pause."""
    marked = log.withWatermark("event_time", delay)
    return marked.groupBy("user_id", F.session_window("event_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def events_log(events: DataFrame) -> DataFrame:
    """The log of a stream of events (see the batch queries of the board)."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("in_progress")
    return events.select((F.col("user_id") * 5 + F.col("event_id") % 5).alias("task_id"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("event_time"), status.alias("status"))
