"""Task board: state of tasks from their log (task_id, ts in seconds, event_id, status), and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def latest(log: DataFrame) -> DataFrame:
    """(task_id, status, updated_at, created_at, attempts): the last event decides, terminal or not."""
    order = F.struct("ts", "event_id")
    return log.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max("ts").alias("updated_at"),
        F.min("ts").alias("created_at"),
        F.sum(F.when(F.col("status") == "in_progress", 1).otherwise(0)).alias("attempts"),
    )


def timed_out(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    return tasks.where((F.col("status") == "in_progress") & (now - F.col("updated_at") > limit))


def evicted(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    return tasks.where(F.col("status").isin(*TERMINAL) & (now - F.col("updated_at") > limit))


def recovered(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    """What a restart keeps: pending tasks go, running ones fail, finished ones stay while they are young."""
    kept = tasks.where((F.col("status") == "in_progress") | (F.col("status").isin(*TERMINAL) & (now - F.col("updated_at") <= limit)))
    lost = F.col("status") == "in_progress"
    return kept.withColumn("error", F.when(lost, "executor lost")).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def listed(tasks: DataFrame, session: Column, agent: Column, wanted: list[str]) -> DataFrame:
    """Tasks from or to a session, to an agent, in one of the known states; unknown words match nothing."""
    known = [s for s in wanted if s in ("pending", "in_progress", *TERMINAL)]
    either = (F.col("from_session") == session) | (F.col("to_session") == session)
    return tasks.where(either & (F.col("to_agent") == agent) & (F.col("status").isin(*known) if known else F.lit(False)))


def admits(project_id: Column, prompt: Column) -> Column:
    return project_id.rlike("^[A-Za-z0-9_-]+\\z") & (F.trim(F.coalesce(prompt, F.lit(""))) != "")


def acyclic(sender: Column, chain: Column, target: Column) -> Column:
    return (target != sender) & ~F.array_contains(chain, target)


def admitted(requests: DataFrame, connected: DataFrame) -> DataFrame:
    """Requests (project_id, prompt, to_agent) that are valid and whose target is among the connected (agent)."""
    fine = requests.where(admits(F.col("project_id"), F.col("prompt")))
    return fine.join(connected.select(F.col("agent").alias("to_agent")).distinct(), "to_agent", "left_semi").select(*requests.columns)


def caught_up(waiting: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, failed, result) of the finished tasks (task_id, from_agent, status, result, error) that their sender (task_id, agent) still waits for.

    A failed task without an error has an empty one; a completed one without a result brings nothing.
    """
    mine = tasks.join(waiting.select("task_id", F.col("agent").alias("from_agent")).distinct(), ["task_id", "from_agent"], "left_semi")
    failed = F.col("status") == "failed"
    rows = mine.where(F.col("status").isin(*TERMINAL)).select("task_id", failed.alias("failed"), F.when(failed, F.coalesce("error", F.lit(""))).otherwise(F.col("result")).alias("result"))
    return rows.where("result IS NOT NULL")
