"""Catalogues and sessions after their logs, notes on directories, usage records, verdicts on compaction, tools that are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.jobs.base import Jobs, table
from millrace.operators import catalogue as K
from millrace.operators import conversation as C
from millrace.operators import sessions as S

JOBS = Jobs()
SKILLS = """
WITH l AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type, event_id % 4 AS k,
  'skill' || user_id || CASE WHEN event_id % 7 = 0 THEN '.txt' ELSE '.md' END AS skill_file FROM events),
f AS (SELECT * FROM l WHERE skill_file LIKE '%.md' QUALIFY row_number() OVER (PARTITION BY skill_file ORDER BY seq DESC) = 1),
s AS (SELECT * FROM f WHERE op = 'put')
"""


def _skill_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event puts its user's skill with 1 to 4 phrases, the first of one word; errors delete it, some names are wrong."""
    suffix = F.when(F.col("event_id") % 7 == 0, ".txt").otherwise(".md")
    phrases = F.transform(F.sequence(F.lit(0), F.col("event_id") % 4), lambda i: F.when(i == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" "), i.cast("string"))))
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", K.DELETE).otherwise(K.PUT).alias("op"),
        F.concat(F.lit("skill"), F.col("user_id").cast("string"), suffix).alias("skill_file"),
        F.col("event_id").alias("seq"),
        phrases.alias("phrases"),
    )


@JOBS.add(SKILLS + "SELECT skill_file, seq, (k + 1)::INTEGER AS phrases FROM s")
def skill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill files after a log of puts and deletes."""
    return K.skills(_skill_log(spark, sf_dir))[0].select("skill_file", "seq", F.size("phrases").alias("phrases"))


@JOBS.add(SKILLS + """, n AS (SELECT *, unnest(range(1, k + 1)) AS n FROM s)
SELECT skill_file, n::INTEGER AS n, event_type || ' ' || n AS phrase, replace(skill_file, '.md', '') || '_index_' || n || '.idx' AS path FROM n""")
def skill_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of the skills that are left: those of replaced and deleted files go with them."""
    return K.skills(_skill_log(spark, sf_dir))[1]


@JOBS.add("""WITH l AS (SELECT event_id AS seq, event_type, 'k' || user_id AS name, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events),
v AS (SELECT * FROM l WHERE op = 'delete' OR seq % 5 NOT IN (0, 1)),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1)
SELECT name, seq, event_type AS description, 'body ' || seq AS body FROM f WHERE op = 'put'""")
def knowledge_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge files after puts and deletes; a fifth of the puts names another file, a fifth has no closed front matter."""
    k, name = F.col("event_id") % 5, F.concat(F.lit("k"), F.col("user_id").cast("string"))
    inner = F.when(k == 0, "other").otherwise(name)
    close = F.when(k == 1, "").otherwise("\n---\n")
    content = F.concat(F.lit("---\nname: "), inner, F.lit("\ndescription: "), F.col("event_type"), close, F.lit("body "), F.col("event_id").cast("string"))
    op = F.when(F.col("event_type") == "error", K.DELETE).otherwise(K.PUT)
    return K.knowledge(table(spark, sf_dir, "events").select(op.alias("op"), name.alias("name"), F.col("event_id").alias("seq"), content.alias("content")))


@JOBS.add("""SELECT user_id, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS prompt_tokens, sum(event_id % 50)::BIGINT AS completion_tokens,
  sum(CASE WHEN event_id % 3 = 0 THEN event_id % 10 ELSE 0 END)::BIGINT AS reasoning_tokens,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE value::DECIMAL(18, 6) END)::DOUBLE AS cost FROM events WHERE event_id % 11 <> 0 GROUP BY user_id""")
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and costs of each user's usage records; errors have no cost, a third has reasoning tokens, some events have no record."""
    details = F.when(F.col("event_id") % 3 == 0, F.struct((F.col("event_id") % 10).alias("reasoning_tokens")))
    usage = F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"),
        (F.col("event_id") % 50).alias("completion_tokens"),
        F.when(F.col("event_type") != "error", F.col("value").cast("decimal(18,6)")).alias("cost"),
        details.alias("completion_tokens_details"),
    )
    return C.usage_totals(table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 11 != 0, F.to_json(usage)).alias("usage")), "user_id")


@JOBS.add("""WITH p AS (SELECT conv_id, role, CASE WHEN conv_id % 4 = 1 THEN text ELSE left(text, 40) END AS text FROM conversations
  WHERE conv_id % 4 <> 0 AND (conv_id % 4 = 3 OR role <> 'system')),
a AS (SELECT conv_id, sum(strlen(coalesce(text, '')))::BIGINT AS after, bool_and(coalesce(role IN ('user', 'assistant'), false)) AS roles FROM p GROUP BY conv_id),
b AS (SELECT conv_id, sum(strlen(coalesce(text, '')))::BIGINT AS before FROM conversations GROUP BY conv_id)
SELECT b.conv_id, before, after, CASE WHEN after IS NULL THEN 'empty' WHEN NOT roles THEN 'role' WHEN after >= before THEN 'size' ELSE 'accepted' END AS verdict
FROM b LEFT JOIN a ON a.conv_id = b.conv_id""")
def compaction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on proposed compactions: a quarter proposes nothing, a quarter the texts as they are, the rest their beginnings, half with system messages."""
    rows, k = table(spark, sf_dir, "conversations"), F.col("conv_id") % 4
    text = F.when(k == 1, F.col("text")).otherwise(F.substring("text", 1, 40))
    proposed = rows.where((k != 0) & ((k == 3) | (F.col("role") != "system"))).select("conv_id", "role", text.alias("text"))
    return C.compaction_verdicts(rows, proposed)


@JOBS.add("""WITH l AS (SELECT event_id AS seq, user_id AS session_id, CASE WHEN event_id % 3 > 0 THEN 'agent' || (event_id % 3) END AS owner_agent, event_type AS display_name,
  event_type = 'error' AND event_id % 10 = 0 AS deleted, CASE WHEN event_id % 2 = 0 THEN '***' END AS api_key, CASE WHEN event_id % 2 = 0 THEN props END AS model FROM events)
SELECT owner_agent, session_id, max(seq) AS seq, arg_max(display_name, seq) AS display_name, bool_or(deleted) AS deleted,
  arg_max({'v': api_key}, seq).v AS api_key, arg_max({'v': model}, seq).v AS model FROM l GROUP BY ALL""")
def saved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after all saves: deleted ones stay deleted, keys are masked. Half of the saves have no context."""
    config = F.struct(F.concat(F.lit("key-"), F.col("event_id").cast("string")).alias("api_key"), F.col("props").alias("model"))
    saves = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("agent"), (F.col("event_id") % 3).cast("string"))).alias("owner_agent"),
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("display_name"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)).alias("deleted"),
        F.when(F.col("event_id") % 2 == 0, F.struct(config.alias("engine_config"))).alias("context"),
    )
    return S.saved(saves, "seq").select("owner_agent", "session_id", "seq", "display_name", "deleted", "context.engine_config.api_key", "context.engine_config.model")


@JOBS.add("""WITH l AS (SELECT event_id AS seq, 'p' || (user_id % 5) AS project_id, 'd' || (user_id // 5) AS dir, event_type || event_id AS content,
  CASE event_type WHEN 'click' THEN 'about' WHEN 'view' THEN 'summary' ELSE event_type END AS kind FROM events)
SELECT project_id, dir, arg_max(content, seq) FILTER (WHERE kind = 'about') AS about, arg_max(content, seq) FILTER (WHERE kind = 'summary') AS summary
FROM l WHERE kind IN ('about', 'summary') GROUP BY project_id, dir""")
def directory_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About and summary of each directory after all writes."""
    kind = F.when(F.col("event_type") == "click", "about").when(F.col("event_type") == "view", "summary").otherwise(F.col("event_type"))
    writes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("d"), F.expr("user_id div 5").cast("string")).alias("dir"),
        kind.alias("kind"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("content"),
        F.col("event_id").alias("seq"),
    )
    return S.directory_notes(writes, "seq")


@JOBS.add("""WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
l AS (SELECT item_id, w[1:8] || CASE WHEN item_id % 3 = 0 THEN []::VARCHAR[] ELSE w[5:12] END || ['memory', 'help', w[1]] AS l FROM w)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS tools FROM l""")
def visible_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that a search found, those that are mentioned and those that are always shown, each once, in this order."""
    words = F.split(F.lower("text"), " ")
    mentioned = F.when(F.col("item_id") % 3 != 0, F.slice(words, 5, 8))
    shown = X.ordered_union(F.slice(words, 1, 8), mentioned, F.array(F.lit("memory"), F.lit("help"), words[0]))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(shown, " ").alias("tools"))


@JOBS.add("""WITH e AS (SELECT conv_id % 7 AS owner, 'n' || conv_id || '_' || turn AS name, role AS description FROM conversations),
r AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY name) - 1) // 50 AS part FROM e)
SELECT owner, part, '""" + K.CATALOGUE_HEAD + """' || string_agg('- ' || name || ' — ' || description || chr(10), '' ORDER BY name) || '""" + K.CATALOGUE_TAIL + """' AS prompt FROM r GROUP BY owner, part""")
def catalogue_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner knows, as text to show, in parts of 50 entries."""
    rows = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return K.catalogue_prompts(rows.select((F.col("conv_id") % 7).alias("owner"), name.alias("name"), F.col("role").alias("description")), ["owner"], 50)


@JOBS.add(r"""SELECT event_id, CASE WHEN n = '' THEN 'default' ELSE n END || '_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') AS project_id FROM (
SELECT event_id, ts, regexp_replace(lower(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type || ' №' WHEN 2 THEN props ELSE upper(event_type) END), '[^a-z0-9_]', '_', 'g') AS n FROM events)""")
def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of projects made of event names."""
    k = F.col("event_id") % 4
    name = F.when(k == 0, "").when(k == 1, F.concat("event_type", F.lit(" №"))).when(k == 2, F.col("props")).otherwise(F.upper("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.project_id(name, F.col("ts")).alias("project_id"))
