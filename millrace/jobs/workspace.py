"""Workspace upkeep queries: tools, purges, archives, rebukes, arguments, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.jobs.base import Jobs, table
from millrace.operators import code as C
from millrace.operators import running as R
from millrace.operators.mentions import mentions, text_key

JOBS = Jobs()
TOOLS = "WITH t AS (SELECT item_id, lower(split_part(text, ' ', 1)) || '_' || (item_id % 3) AS name, lower(text) || ' ' || lower(split_part(text, ' ', 2)) || '_' || (item_id % 2) AS description FROM benchmark)"


@JOBS.add(TOOLS + " SELECT a.item_id, a.name FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.name <> a.name AND contains(a.description, b.name))")
def tool_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools whose description names no other tool."""
    word = lambda i: F.lower(F.split("text", " ")[i])
    t = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.concat(word(0), F.lit("_"), (F.col("item_id") % 3).cast("string")).alias("name"),
        F.concat(F.lower("text"), F.lit(" "), word(1), F.lit("_"), (F.col("item_id") % 2).cast("string")).alias("description"),
    )
    found = mentions(t.select(F.col("description").alias("text")), t.select("name"))
    found = found.groupBy("key").agg(F.min("name").alias("first"), F.max("name").alias("last"))
    other = (F.col("first") != F.col("name")) | (F.col("last") != F.col("name"))
    rows = t.withColumn("key", text_key(F.col("description"))).join(found, "key", "left")
    return rows.where(~F.coalesce(other, F.lit(False))).select("item_id", "name")


@JOBS.add(r"""WITH f AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'chat_' || user_id ELSE 'agent_bot' || (user_id % 4) || '_' || user_id END
  || CASE event_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.lock' ELSE '.log' END AS file FROM events)
SELECT file, count(*) AS n FROM f WHERE NOT regexp_full_match(file, '(chat|agent_[^_]+)_(3|4|15)\.(json|lock|log)') GROUP BY file""")
def purged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session, lock and log files that are left after some sessions are purged by their names."""
    u, e = F.col("user_id").cast("string"), F.col("event_id") % 3
    owner = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("chat_"), u)).otherwise(F.concat(F.lit("agent_bot"), (F.col("user_id") % 4).cast("string"), F.lit("_"), u))
    file = F.concat(owner, F.when(e == 0, ".json").when(e == 1, ".lock").otherwise(".log"))
    rows = table(spark, sf_dir, "events").select(file.alias("file")).where(~F.col("file").rlike("^(chat|agent_[^_]+)_(3|4|15)\\.(json|lock|log)\\z"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@JOBS.add("""WITH m AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn, CASE WHEN 2 * turn + 1 > last THEN 'leaf' ELSE 'archive' END AS kind FROM m WHERE turn = last OR 2 * turn + 1 > last""")
def unfrozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fully flattened archives: the turns that hold no others, and the last one."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = table(spark, sf_dir, "conversations").join(last, "conv_id")
    leaf = 2 * F.col("turn") + 1 > F.col("last")
    return rows.where(leaf | (F.col("turn") == F.col("last"))).select("conv_id", "turn", F.when(leaf, "leaf").otherwise("archive").alias("kind"))


@JOBS.add("""WITH r AS (SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, count(*) FILTER (WHERE t <> '')::INTEGER AS n, 'Be brief.' || coalesce(string_agg(' ' || t || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE '.' END, '' ORDER BY turn) FILTER (WHERE t <> ''), '') AS system
FROM r GROUP BY conv_id""")
def rebuked_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuke file of each conversation's user messages, read back and put behind the system text."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    entry = lambda x: F.concat(F.lit("---["), x["turn"].cast("string"), F.lit("]--------\n"), x["text"], F.lit("\n"))
    content = rows.groupBy("conv_id").agg(F.array_join(F.transform(listed, entry), "").alias("content"))
    texts = X.rebukes(F.col("content"))
    return content.select("conv_id", F.size(texts).alias("n"), X.with_rebukes(F.lit("Be brief."), texts).alias("system"))


@JOBS.add("""WITH r AS (SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM conversations WHERE role = 'user'),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS part FROM r WHERE t <> '')
SELECT conv_id, part, count(*) AS n, string_agg(' ' || t || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE '.' END, '' ORDER BY turn) AS said FROM p GROUP BY conv_id, part""")
def rebuke_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user messages of a conversation as rebukes, in numbered parts of three: any number of them fits."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.regexp_replace("text", "^\\s+|\\s+$", "").alias("t")).where("t <> ''")
    said = F.concat(F.lit(" "), F.col("t"), F.when(F.col("t").rlike("[.!?]$"), "").otherwise("."))
    out = R.parts(rows, ["conv_id"], ["turn"], said, 3)
    return out.select("conv_id", "part", F.size("items").cast("bigint").alias("n"), F.array_join("items", "").alias("said"))


@JOBS.add("""SELECT event_id, coalesce(json_extract_string(p, '$.Key'), json_extract_string(p, '$.k'), '') AS value FROM (
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"Key": "a' || event_id || '"}' WHEN 1 THEN props ELSE '{}' END AS p FROM events)""")
def json_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two keys that is there."""
    k = F.col("event_id") % 3
    p = F.when(k == 0, F.concat(F.lit('{"Key": "a'), F.col("event_id").cast("string"), F.lit('"}'))).when(k == 1, F.col("props")).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", X.first_of(p, "Key", "k").alias("value"))


@JOBS.add("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) AS n FROM events GROUP BY user_id
HAVING count(*) FILTER (WHERE event_type <> 'error') >= 3""")
def successful_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with at least three tool results that aren't failures."""
    result = F.when(F.col("event_type") == "error", X.failure(F.lit("broken"))).otherwise(X.ok_content(F.col("props")))
    rows = table(spark, sf_dir, "events").select("user_id", X.is_success(result).alias("fine"))
    return rows.groupBy("user_id").agg(F.sum(F.col("fine").cast("bigint")).alias("success"), F.count(F.lit(1)).alias("n")).where("success >= 3")


@JOBS.add("""SELECT source, count(*) AS files, string_agg(doc_id || ':' || len(string_split(coalesce(text, ''), chr(10))), ',' ORDER BY doc_id) AS nested FROM documents GROUP BY source""")
def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module with its files nested in order."""
    rows = table(spark, sf_dir, "documents").select("source", F.struct("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")).alias("f"))
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("f")).alias("l"))
    shown = F.transform("l", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["lines"].cast("string")))
    return out.select("source", "files", F.array_join(shown, ",").alias("nested"))


@JOBS.add("""WITH r AS (SELECT source, doc_id, doc_id || ':' || len(string_split(coalesce(text, ''), chr(10))) AS shown, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS part FROM documents)
SELECT source, part, count(*) AS files, string_agg(shown, ',' ORDER BY doc_id) AS nested FROM r GROUP BY source, part""")
def module_file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with their files nested in order, in numbered parts of 100 files: a module of any size fits."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    shown = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("lines").cast("string"))
    out = R.parts(rows, ["source"], ["doc_id"], shown, 100)
    return out.select("source", "part", F.size("items").cast("bigint").alias("files"), F.array_join("items", ",").alias("nested"))


@JOBS.add("""WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) || CASE page_id % 6 WHEN 0 THEN '.PY' WHEN 1 THEN '.rs' WHEN 2 THEN '.h' WHEN 3 THEN '.txt' WHEN 4 THEN '.sql' ELSE '' END AS f FROM pages)
SELECT CASE WHEN f LIKE '%.PY' THEN 'Python' WHEN f LIKE '%.rs' THEN 'Rust' WHEN f LIKE '%.h' THEN 'C' ELSE 'Other' END AS language, count(*) AS n FROM p GROUP BY 1""")
def languages_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)/?$", 1)
    k = F.col("page_id") % 6
    ext = F.when(k == 0, ".PY").when(k == 1, ".rs").when(k == 2, ".h").when(k == 3, ".txt").when(k == 4, ".sql").otherwise("")
    rows = table(spark, sf_dir, "pages").select(C.language(F.concat(name, ext)).alias("language"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
