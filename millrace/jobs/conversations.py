"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.jobs.base import Jobs, table
from millrace.operators import archives as A
from millrace.operators import conversation as C
from millrace.operators import fragments as P
from millrace.operators import running as R

JOBS = Jobs()

GROUPED = """
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS opened FROM conversations WHERE role <> 'system'),
g AS (SELECT *, sum(CASE WHEN role = 'user' OR opened = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM m),
t AS (SELECT conv_id, turn_no::BIGINT AS turn_no, count(*) AS n_messages, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, max(role = 'user') AS by_user FROM g GROUP BY conv_id, turn_no)
"""
RETAINED = """, p AS (SELECT *, by_user AND sum(CASE WHEN by_user THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn_no) <= 1 AS pinned FROM t),
r AS (SELECT *, row_number() OVER w AS rn, sum(bytes) OVER w AS cum FROM p WINDOW w AS (PARTITION BY conv_id, pinned ORDER BY turn_no DESC)),
k AS (SELECT conv_id, turn_no, n_messages, bytes, by_user, CASE WHEN pinned THEN 'prefix' WHEN rn = 1 OR (rn <= 2 AND cum <= 1500) THEN 'tail' END AS slot FROM r)
"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@JOBS.add(GROUPED + "SELECT * FROM t")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turns(_messages(spark, sf_dir))


@JOBS.add(GROUPED + RETAINED + "SELECT * FROM k WHERE slot IS NOT NULL")
def prefix_tail_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retained(C.turns(_messages(spark, sf_dir)), prefix=1, tail=2, budget=1500)


@JOBS.add("""SELECT conv_id, sum(strlen(text))::BIGINT AS before, sum(strlen(c))::BIGINT AS after, count(*) FILTER (WHERE c <> text) AS changed FROM (
SELECT conv_id, text, CASE WHEN role = 'assistant' AND strlen(text) > 512 THEN '[compacted ' || strlen(text) || ' bytes]' ELSE text END AS c FROM conversations) GROUP BY conv_id""")
def compaction_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("c", C.compacted(F.col("role"), F.col("text"), 512))
    return rows.groupBy("conv_id").agg(
        F.sum(C.size(F.col("text"))).alias("before"), F.sum(C.size(F.col("c"))).alias("after"), F.sum(F.when(F.col("c") != F.col("text"), 1).otherwise(0)).alias("changed")
    )


@JOBS.add("""SELECT conv_id, role, sum(strlen(text))::BIGINT AS bytes, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words, count(*) AS n
FROM conversations GROUP BY ROLLUP (conv_id, role)""")
def context_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and words of each zone, each conversation and all."""
    words = F.size(F.array_remove(F.split("text", "\\s+"), "")).cast("bigint")
    rows = _messages(spark, sf_dir).select("conv_id", "role", C.size(F.col("text")).alias("b"), words.alias("w"))
    return rows.rollup("conv_id", "role").agg(F.sum("b").alias("bytes"), F.sum("w").alias("words"), F.count(F.lit(1)).alias("n"))


@JOBS.add(GROUPED + """, l AS (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last_no FROM g),
s AS (SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn_no = last_no AND role = 'user'), '') AS short,
  arg_max(text, turn) FILTER (WHERE turn_no < last_no AND role = 'assistant' AND trim(text) <> '') AS answer FROM l GROUP BY conv_id)
SELECT conv_id, short, concat_ws(chr(10) || chr(10), answer, CASE WHEN short <> '' THEN short END) AS "full" FROM s""")
def search_text_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_text(_messages(spark, sf_dir))


@JOBS.add("""SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS calls,
  sum(CASE WHEN role <> 'assistant' THEN strlen(text) // 4 ELSE 0 END)::BIGINT AS prompt_tokens,
  sum(CASE WHEN role = 'assistant' THEN strlen(text) // 4 ELSE 0 END)::BIGINT AS completion_tokens FROM conversations GROUP BY conv_id""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as a quarter of bytes, one call for each answer."""
    tokens = F.floor(C.size(F.col("text")) / 4)
    answer = F.col("role") == "assistant"
    return _messages(spark, sf_dir).groupBy("conv_id").agg(
        F.sum(F.when(answer, 1).otherwise(0)).alias("calls"),
        F.sum(F.when(~answer, tokens).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(answer, tokens).otherwise(0)).alias("completion_tokens"),
    )


@JOBS.add("""WITH c AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations)
SELECT conv_id, turn, spent::BIGINT AS spent FROM c WHERE spent < 2000""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages until the running cost reaches the limit."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return _messages(spark, sf_dir).select("conv_id", "turn", F.sum(C.size(F.col("text"))).over(order).alias("spent")).where("spent < 2000")


@JOBS.add(GROUPED + """SELECT conv_id, string_agg(lower(role) || ': ' || text, chr(10) ORDER BY turn) AS shown FROM g GROUP BY conv_id""")
def serialized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.grouped(_messages(spark, sf_dir)).select("conv_id", F.struct("turn", F.concat(F.lower("role"), F.lit(": "), F.col("text")).alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("shown"))


@JOBS.add(GROUPED + """, p AS (SELECT conv_id, turn, lower(role) || ': ' || text AS line, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS part FROM g)
SELECT conv_id, part, count(*) AS n, string_agg(line, chr(10) ORDER BY turn) AS shown FROM p GROUP BY conv_id, part""")
def serialized_turn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text in numbered parts of four messages: a conversation of any length fits."""
    line = F.concat(F.lower("role"), F.lit(": "), F.col("text"))
    rows = R.parts(C.grouped(_messages(spark, sf_dir)), ["conv_id"], ["turn"], line, 4)
    return rows.select("conv_id", "part", F.size("items").cast("bigint").alias("n"), F.array_join("items", "\n").alias("shown"))


@JOBS.add("""WITH f AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS piece, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, i % 3 AS idx, count(*) AS n, string_agg(piece, '' ORDER BY i) AS arguments FROM f GROUP BY conv_id, turn, i % 3""")
def stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that arrive interleaved are put together by index, in order of arrival."""
    rows = _messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "piece"))
    rows = rows.groupBy("conv_id", "turn", (F.col("i") % 3).cast("bigint").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("p"))
    return rows.select("conv_id", "turn", "idx", "n", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("arguments"))


@JOBS.add("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS parent FROM conversations),
w AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM t WHERE parent IS NULL
      UNION ALL SELECT t.conv_id, t.turn, w.root, w.depth + 1 FROM t JOIN w ON t.conv_id = w.conv_id AND t.parent = w.turn)
SELECT conv_id, count(*) AS archived, max(depth)::INTEGER AS depth, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = w.conv_id AND t.parent = w.turn)) AS leaves
FROM w GROUP BY conv_id""")
def archive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested archives (each message's parent is (turn - 1) / 2): size, depth and leaves of each tree, by pointer doubling."""
    t = _messages(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"))
    depth = A.over_ancestors(t.withColumn("value", F.when(F.col("parent").isNull(), 0).otherwise(1)))
    parents = t.where("parent IS NOT NULL").select("conv_id", F.col("parent").alias("turn"), F.lit(True).alias("inner")).distinct()
    rows = depth.join(parents, ["conv_id", "turn"], "left")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("archived"), F.max("sum").cast("int").alias("depth"), F.sum(F.when(F.col("inner"), 0).otherwise(1)).alias("leaves"))


FOREST = """WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn >= 3 THEN turn // 3 END AS parent FROM conversations),
n AS (SELECT *, EXISTS (SELECT 1 FROM t c WHERE c.conv_id = t.conv_id AND c.parent = t.turn) AS archived FROM t),
"""


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three messages of a conversation are in the open, others inside a third of their number."""
    t = _messages(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") >= 3, F.floor(F.col("turn") / 3)).cast("int").alias("parent"), F.col("turn").alias("place"))
    parents = t.where("parent IS NOT NULL").select("conv_id", F.col("parent").alias("turn"), F.lit(True).alias("archived")).distinct()
    return t.join(parents, ["conv_id", "turn"], "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


@JOBS.add(FOREST + """w AS (SELECT conv_id, turn, archived, [turn] AS path FROM n WHERE parent IS NULL
  UNION ALL SELECT n.conv_id, n.turn, n.archived, list_append(w.path, n.turn) FROM n JOIN w ON n.conv_id = w.conv_id AND n.parent = w.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place, turn, len(path) > 1 AS restored FROM w WHERE NOT archived""")
def unfreeze_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nested archives opened, in order."""
    return A.unfreeze_all(_forest(spark, sf_dir))


@JOBS.add(FOREST + """l AS (SELECT conv_id, max(turn) AS last FROM n WHERE parent IS NULL AND archived GROUP BY conv_id),
o AS (SELECT n.*, coalesce(parent = last, false) AS restored, last FROM n LEFT JOIN l ON n.conv_id = l.conv_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN restored THEN last ELSE turn END, turn) - 1 AS place, turn, restored FROM o
WHERE (parent IS NULL AND turn IS DISTINCT FROM last) OR restored""")
def unfreeze_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last archive in the open, opened by one level."""
    return A.unfreeze_last(_forest(spark, sf_dir))


@JOBS.add("""WITH p AS (SELECT conv_id || '/' || turn AS stream, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
f AS (SELECT stream, unnest(range(len(w))) AS seq, unnest(w) AS piece FROM p WHERE len(w) % 5 <> 3)
SELECT stream, seq % 3 AS idx, 'c' || max(seq) AS id, coalesce(string_agg(piece, '' ORDER BY seq) FILTER (WHERE seq < 3), '') AS name, coalesce(string_agg(piece, '' ORDER BY seq) FILTER (WHERE seq >= 3), '') AS arguments
FROM f GROUP BY stream, seq % 3""")
def assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of answers as fragments of three calls, out of order and repeated; of some streams the last but one is lost."""
    rows = _messages(spark, sf_dir).where("role = 'assistant'").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("stream"), F.split("text", " ").alias("w"))
    rows = rows.select("stream", F.size("w").alias("n"), F.posexplode("w").alias("seq", "piece"))
    name = F.when(F.col("seq") < 3, F.col("piece"))
    fragments = rows.select(
        "stream", F.col("seq").cast("bigint").alias("seq"), (F.col("seq") % 3).alias("idx"), F.concat(F.lit("c"), F.col("seq").cast("string")).alias("id"), name.alias("name"),
        F.when(name.isNull(), F.col("piece")).alias("arguments"), (F.col("seq") == F.col("n") - 1).alias("last"), "n",
    )
    kept = fragments.where("n % 5 <> 3 OR (n > 1 AND seq <> n - 2)")
    return P.assembled(kept.drop("n").unionByName(kept.where("seq % 4 = 1").drop("n")))


@JOBS.add("""SELECT conv_id, max(turn) AS updated_at, count(*) AS n, row_number() OVER (ORDER BY max(turn) DESC, conv_id)::INTEGER AS place FROM conversations
WHERE conv_id % 9 <> 4 GROUP BY conv_id""")
def sessions_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that aren't deleted, the last updated first; places by a running count over update times."""
    rows = _messages(spark, sf_dir).where("conv_id % 9 <> 4").groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("updated_at").orderBy("conv_id")
    counts = rows.groupBy("updated_at").agg(F.count(F.lit(1)).alias("same"))
    newer = Window.orderBy(F.desc("updated_at")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("updated_at", F.coalesce(F.sum("same").over(newer), F.lit(0)).alias("before"))
    return rows.join(before, "updated_at").select("conv_id", "updated_at", "n", (F.col("before") + F.row_number().over(order)).cast("int").alias("place"))
