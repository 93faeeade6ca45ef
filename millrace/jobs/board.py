"""Task board queries. Events are the log: a task is one of five of its user's, types are states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.jobs.base import Jobs, table
from millrace.operators import board as B

JOBS = Jobs()
LIMIT = 21_600

LOG = """
WITH log AS (SELECT user_id * 5 + event_id % 5 AS task_id, user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS ts, value,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status FROM events),
n AS (SELECT max(ts) AS now FROM log),
t AS (SELECT task_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, min(ts) AS created_at, count(*) FILTER (WHERE status = 'in_progress') AS attempts FROM log GROUP BY task_id)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("in_progress")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 5 + F.col("event_id") % 5).alias("task_id"), "user_id", "event_id", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("ts"), "value", status.alias("status")
    )


def _now(log: DataFrame):
    return F.lit(log.agg(F.max("ts")).first()[0])


@JOBS.add(LOG + "SELECT * FROM t")
def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(_log(spark, sf_dir))


@JOBS.add(LOG + f"SELECT task_id, updated_at FROM t, n WHERE status = 'in_progress' AND now - updated_at > {LIMIT}")
def task_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return B.timed_out(B.latest(log), _now(log), LIMIT).select("task_id", "updated_at")


@JOBS.add(LOG + f"SELECT task_id, status, updated_at FROM t, n WHERE status IN ('completed', 'failed') AND now - updated_at > {LIMIT}")
def task_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return B.evicted(B.latest(log), _now(log), LIMIT).select("task_id", "status", "updated_at")


@JOBS.add(LOG + f"""SELECT task_id, CASE WHEN status = 'in_progress' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'in_progress' THEN 'executor lost' END AS error
FROM t, n WHERE status = 'in_progress' OR (status IN ('completed', 'failed') AND now - updated_at <= {LIMIT})""")
def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return B.recovered(B.latest(log), _now(log), LIMIT).select("task_id", "status", "error")


@JOBS.add(LOG + """, s AS (SELECT *, task_id % 3 AS from_session, (task_id // 3) % 3 AS to_session, task_id % 2 AS to_agent FROM t)
SELECT task_id, status FROM s WHERE (from_session = 1 OR to_session = 1) AND to_agent = 0 AND status IN ('in_progress', 'failed')""")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.latest(_log(spark, sf_dir)).select("*", (F.col("task_id") % 3).alias("from_session"), (F.floor(F.col("task_id") / 3) % 3).alias("to_session"), (F.col("task_id") % 2).alias("to_agent"))
    return B.listed(t, F.lit(1), F.lit(0), ["in_progress", "failed", "unheard_of"]).select("task_id", "status")


@JOBS.add(LOG + """SELECT l.event_id, l.task_id, l.status FROM log l WHERE status IN ('completed', 'failed')
AND NOT EXISTS (SELECT 1 FROM log o WHERE o.task_id = l.task_id AND o.status = 'pending' AND o.ts <= l.ts)""")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without a request before them go to a dead-letter table."""
    log = _log(spark, sf_dir)
    asked = log.where("status = 'pending'").groupBy("task_id").agg(F.min("ts").alias("asked"))
    return log.where(F.col("status").isin(*B.TERMINAL)).join(asked, "task_id", "left").where("asked IS NULL OR asked > ts").select("event_id", "task_id", "status")


@JOBS.add(LOG + """, d AS (SELECT task_id, min(ts) AS asked FROM log WHERE status = 'pending' GROUP BY task_id),
a AS (SELECT l.task_id, min(l.ts) AS answered FROM log l JOIN d ON d.task_id = l.task_id WHERE l.status IN ('completed', 'failed') AND l.ts >= d.asked GROUP BY l.task_id)
SELECT d.task_id, answered - asked AS waited, answered - asked > 7200 AS expired FROM d JOIN a USING (task_id)""")
def pending_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the first result after them."""
    log = _log(spark, sf_dir)
    asked = log.where("status = 'pending'").groupBy("task_id").agg(F.min("ts").alias("asked"))
    done = log.where(F.col("status").isin(*B.TERMINAL)).join(asked, "task_id").where("ts >= asked")
    out = done.groupBy("task_id").agg((F.min("ts") - F.min("asked")).alias("waited"))
    return out.withColumn("expired", F.col("waited") > 7200)


@JOBS.add(LOG + """SELECT user_id, count(*) FILTER (WHERE status = 'completed') AS success, count(*) FILTER (WHERE status = 'failed') AS fail FROM log GROUP BY user_id""")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return _log(spark, sf_dir).groupBy("user_id").agg(n("completed").alias("success"), n("failed").alias("fail"))


@JOBS.add("""SELECT event_id, user_id, user_id % 10 AS sender, ((user_id + 1) % 10) || ',' || ((user_id // 10) % 10) AS chain, event_id % 10 AS target FROM events
WHERE event_id % 10 NOT IN (user_id % 10, (user_id + 1) % 10, (user_id // 10) % 10)""")
def cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose target is neither the sender nor in the chain of callers."""
    u, ten = F.col("user_id"), F.lit(10)
    chain = F.array((u + 1) % ten, F.floor(u / 10) % ten)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (u % ten).alias("sender"), chain.alias("chain"), (F.col("event_id") % ten).alias("target"))
    return rows.where(B.acyclic(F.col("sender"), F.col("chain"), F.col("target"))).withColumn("chain", F.array_join(F.col("chain").cast("array<string>"), ","))


@JOBS.add("""WITH s AS (SELECT user_id % 7 AS name, user_id, max(epoch(date_trunc('second', ts))::BIGINT) AS updated_at FROM events GROUP BY ALL)
SELECT name, arg_max(user_id, (updated_at, -user_id)) AS latest, max(updated_at) AS updated_at FROM s GROUP BY name""")
def latest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _log(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("name"), "user_id").agg(F.max("ts").alias("updated_at"))
    return s.groupBy("name").agg(F.max_by("user_id", F.struct("updated_at", -F.col("user_id"))).alias("latest"), F.max("updated_at").alias("updated_at"))


@JOBS.add(LOG + """, x AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM log),
y AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS opened, max(ts) + 1800 AS expires FROM y GROUP BY user_id, session""")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end 1800 s after their last event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _log(spark, sf_dir).withColumn("gap", F.col("ts") - F.lag("ts").over(order))
    rows = rows.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1800), 1).otherwise(0)).over(order))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("opened"), (F.max("ts") + 1800).alias("expires"))


@JOBS.add(LOG + """, o AS (SELECT user_id, task_id, max(event_id) FILTER (WHERE status = 'in_progress') AS pushed, max(event_id) FILTER (WHERE status IN ('completed', 'failed')) AS popped FROM log GROUP BY ALL)
SELECT user_id, arg_max(task_id, pushed) AS top, count(*) AS depth FROM o WHERE pushed IS NOT NULL AND (popped IS NULL OR popped < pushed) GROUP BY user_id""")
def waiting_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the tasks that each user waits for, and how many there are."""
    last = lambda c, name: F.max(F.when(c, F.col("event_id"))).alias(name)
    rows = _log(spark, sf_dir).groupBy("user_id", "task_id").agg(last(F.col("status") == "in_progress", "pushed"), last(F.col("status").isin(*B.TERMINAL), "popped"))
    rows = rows.where("pushed IS NOT NULL AND (popped IS NULL OR popped < pushed)")
    return rows.groupBy("user_id").agg(F.max_by("task_id", "pushed").alias("top"), F.count(F.lit(1)).alias("depth"))


@JOBS.add("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events
WHERE regexp_full_match('p' || (user_id % 9) || CASE WHEN event_id % 11 = 0 THEN '/x' ELSE '' END, '[A-Za-z0-9_-]+') AND coalesce(json_extract_string(props, '$.k'), '') <> ''""")
def task_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a valid project id and a prompt that isn't blank."""
    project = F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string"), F.when(F.col("event_id") % 11 == 0, "/x").otherwise(""))
    prompt = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(B.admits(project, prompt)).select("event_id", prompt.cast("bigint").alias("k"))


@JOBS.add("""WITH r AS (SELECT event_id, 'p' || (user_id % 9) || CASE WHEN event_id % 11 = 0 THEN '/x' ELSE '' END AS project_id, json_extract_string(props, '$.k') AS prompt, user_id % 10 AS to_agent FROM events)
SELECT event_id, to_agent FROM r WHERE regexp_full_match(project_id, '[A-Za-z0-9_-]+') AND trim(coalesce(prompt, '')) <> '' AND to_agent IN (SELECT user_id % 10 FROM events WHERE event_type = 'signup' AND user_id % 10 <> 3)""")
def admitted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid requests to agents that are connected (those that signed up, but for one)."""
    e = table(spark, sf_dir, "events")
    project = F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string"), F.when(F.col("event_id") % 11 == 0, "/x").otherwise(""))
    requests = e.select("event_id", project.alias("project_id"), F.get_json_object("props", "$.k").alias("prompt"), (F.col("user_id") % 10).alias("to_agent"))
    connected = e.where("event_type = 'signup' AND user_id % 10 <> 3").select((F.col("user_id") % 10).alias("agent"))
    return B.admitted(requests, connected).select("event_id", "to_agent")


@JOBS.add("""WITH t AS (SELECT event_id AS task_id, user_id % 10 AS from_agent, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'in_progress' END AS status,
  CASE WHEN event_id % 5 <> 1 THEN props END AS result, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS error FROM events)
SELECT task_id, status = 'failed' AS failed, CASE WHEN status = 'failed' THEN coalesce(error, '') ELSE result END AS result FROM t
WHERE from_agent = 4 AND task_id % 2 = 0 AND (status = 'failed' OR status = 'completed' AND result IS NOT NULL)""")
def caught_up_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished tasks that an agent still waits for, as it asks for them after an outage."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    result, error = F.when(F.col("event_id") % 5 != 1, F.col("props")), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    tasks = e.select(F.col("event_id").alias("task_id"), (F.col("user_id") % 10).alias("from_agent"), status.alias("status"), result.alias("result"), error.alias("error"))
    waiting = e.where("event_id % 2 = 0").select(F.col("event_id").alias("task_id"), F.lit(4).cast("bigint").alias("agent"))
    return B.caught_up(waiting, tasks)
