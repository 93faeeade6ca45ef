"""Search and ranking queries. Vectors with an id divisible by 20 are the phrases, labels the files or tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.base import Jobs, table
from millrace.operators import vectors as V

JOBS = Jobs()

NEAR = """
WITH d AS (
  SELECT q.vec_id AS query_id, q.label AS q_label, c.vec_id, c.label,
         round(list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS dist
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
"""
HITS = NEAR + """, h AS (SELECT q_label AS turn, query_id AS phrase, label, dist FROM r WHERE rank <= 20 AND coalesce(dist, 1) <= 0.9),
a AS (SELECT turn, label, count(DISTINCT phrase) AS hits, min(dist) AS min_dist FROM h GROUP BY turn, label),
s AS (SELECT *, CASE WHEN hits = 0 THEN 0.0 ELSE (1 - min_dist) * hits / (hits + 0.5) END AS score FROM a)
"""
RECORDS = """, t AS (SELECT (doc_id % 10)::INTEGER AS label, sum(quality) AS good, sum(1 - quality) AS bad FROM labels GROUP BY 1)"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = V.knn(e, e.where("vec_id % 20 = 0"), k)
    labels = e.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.within(_near(spark, sf_dir, 20), 0.9).select(F.col("q_label").alias("turn"), F.col("query_id").alias("phrase"), "label", "dist")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.aggregate_hits(_hits(spark, sf_dir), "turn", "label").withColumn("score", V.tool_score(F.col("hits"), F.col("min_dist")))


@JOBS.add(NEAR + "SELECT query_id, vec_id, rank::INTEGER AS rank, round(dist, 4) AS dist FROM r WHERE rank <= 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return V.knn(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", "rank", F.round("dist", 4).alias("dist"))


@JOBS.add(NEAR + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE rank <= 64 AND label % 3 = q_label % 3)
SELECT query_id, vec_id, place::INTEGER AS rank, round(dist, 4) AS dist FROM p WHERE place <= 5""")
def knn_project_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all projects first, then the query's own project: fewer than k may be left."""
    own = _near(spark, sf_dir, 64).where("label % 3 = q_label % 3").drop("rank")
    return V.top(own, ["query_id"], [F.col("dist"), F.col("vec_id")], 5).select("query_id", "vec_id", "rank", F.round("dist", 4).alias("dist"))


@JOBS.add(NEAR + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS place FROM r WHERE label % 3 = q_label % 3)
SELECT query_id, vec_id, place::INTEGER AS rank, round(dist, 4) AS dist FROM o WHERE place <= 5""")
def knn_project_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's filter comes before the search."""
    e = table(spark, sf_dir, "embeddings").withColumn("project", F.col("label") % 3)
    found = V.knn(e, e.where("vec_id % 20 = 0"), 5, by="project")
    return found.select("query_id", "vec_id", "rank", F.round("dist", 4).alias("dist"))


@JOBS.add(NEAR + "SELECT query_id, vec_id, round(dist, 4) AS dist FROM r WHERE rank <= 10 AND coalesce(dist, 1) <= 0.75")
def similarity_join_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.within(_near(spark, sf_dir, 10), 0.75).select("query_id", "vec_id", F.round("dist", 4).alias("dist"))


@JOBS.add(HITS + "SELECT turn, label, hits, round(min_dist, 4) AS min_dist FROM a")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.aggregate_hits(_hits(spark, sf_dir), "turn", "label").select("turn", "label", "hits", F.round("min_dist", 4).alias("min_dist"))


@JOBS.add(HITS + """, k AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY round(score, 9) DESC, label) AS rank FROM s WHERE score >= 0.2)
SELECT turn, label, rank::INTEGER AS rank, round(score, 6) AS score FROM k WHERE rank <= 4""")
def tool_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).where("score >= 0.2")
    return V.top(scored, ["turn"], [F.round("score", 9).desc(), F.col("label")], 4).select("turn", "label", "rank", F.round("score", 6).alias("score"))


@JOBS.add(HITS + """, names AS (SELECT DISTINCT label AS name FROM embeddings),
slots AS (SELECT DISTINCT e.label AS turn, n.name FROM embeddings e JOIN names n ON n.name <= e.label % 4 WHERE e.vec_id % 20 = 0),
pool AS (SELECT coalesce(s.turn, p.turn) AS turn, coalesce(s.label, p.name) AS name, coalesce(s.score, 0.0) AS score
         FROM s FULL JOIN slots p ON s.turn = p.turn AND s.label = p.name),
k AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY round(score, 9) DESC, name) AS rank FROM pool WHERE name % 5 <> 3)
SELECT turn, name, rank::INTEGER AS rank, round(score, 6) AS score FROM k WHERE rank <= 4""")
def tool_pool_with_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    names = e.select(F.col("label").alias("name")).distinct()
    turns = e.where("vec_id % 20 = 0").select(F.col("label").alias("turn")).distinct()
    slots = turns.join(names, F.col("name") <= F.col("turn") % 4)
    allowed = names.where("name % 5 <> 3")
    candidates = _scored(spark, sf_dir).select("turn", F.col("label").alias("name"), "score")
    pool = V.pool(candidates, slots, allowed, "turn")
    return V.top(pool, ["turn"], [F.round("score", 9).desc(), F.col("name")], 4).select("turn", "name", "rank", F.round("score", 6).alias("score"))


@JOBS.add(HITS + RECORDS + """, g AS (SELECT a.turn, a.label, a.hits, a.min_dist, good / (good + bad + 1) AS rate, a.label % 2 = a.turn % 2 AS own
  FROM a JOIN t ON a.label = t.label WHERE a.hits >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY own DESC, round(rate, 9) DESC, min_dist, label) AS rank FROM g)
SELECT turn, label, hits, round(rate, 6) AS rate, round(min_dist, 4) AS min_dist FROM k WHERE rank = 1""")
def skill_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own skills first, then the better success rate, then the smaller distance; three hits at least."""
    records = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).cast("int").alias("label"))
    records = records.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    found = V.aggregate_hits(_hits(spark, sf_dir), "turn", "label").where("hits >= 3").join(records, "label")
    found = found.withColumn("rate", V.success_rate(F.col("good"), F.col("bad"))).withColumn("own", F.col("label") % 2 == F.col("turn") % 2)
    best = V.top(found, ["turn"], [F.desc("own"), F.round("rate", 9).desc(), F.col("min_dist"), F.col("label")], 1)
    return best.select("turn", "label", "hits", F.round("rate", 6).alias("rate"), F.round("min_dist", 4).alias("min_dist"))


@JOBS.add(HITS + """, k AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY hits DESC, min_dist, label) AS rank FROM a)
SELECT turn, count(*) AS n, string_agg('=== ' || label || ' ===' || chr(10) || b.text, chr(10) || chr(10) ORDER BY rank) AS block
FROM k JOIN benchmark b ON b.item_id = k.label WHERE rank <= 3 AND trim(b.text) <> '' GROUP BY turn""")
def knowledge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best files of each turn, their bodies joined in order; blank bodies drop out after ranking."""
    found = V.top(V.aggregate_hits(_hits(spark, sf_dir), "turn", "label"), ["turn"], [F.desc("hits"), F.col("min_dist"), F.col("label")], 3)
    bodies = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label"), "text").where("trim(text) <> ''")
    entry = F.concat(F.lit("=== "), F.col("label").cast("string"), F.lit(" ===\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    out = found.join(bodies, "label").groupBy("turn").agg(F.count(F.lit(1)).alias("n"), listed.alias("list"))
    return out.select("turn", "n", F.array_join(F.transform("list", lambda x: x["entry"]), "\n\n").alias("block"))


@JOBS.add("""SELECT (doc_id % 10)::INTEGER AS label, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad,
round(sum(quality) / (sum(quality) + sum(1 - quality) + 1), 6) AS rate FROM labels GROUP BY 1""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).cast("int").alias("label"))
    rows = rows.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    return rows.withColumn("rate", F.round(V.success_rate(F.col("good"), F.col("bad")), 6))


@JOBS.add(NEAR + """SELECT q_label, """ + ", ".join(f"round(min(dist) FILTER (WHERE label = {i}), 4) AS d{i}" for i in range(10)) + " FROM r GROUP BY q_label")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance between the phrases of a label and the vectors of each label, as a matrix."""
    e = table(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id"), "label")
    asked = e.where("vec_id % 20 = 0")
    known = e.agg(F.collect_set("label").alias("known"))  # as many as the matrix has columns
    asked = asked.select("vec_id", "embedding").join(F.broadcast(known), F.lit(True)).select("vec_id", "embedding", F.explode("known").alias("label"))
    found = V.knn(e, asked, 1, by="label").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    out = found.groupBy("q_label").pivot("label", list(range(10))).agg(F.round(F.min("dist"), 4))
    return out.withColumnsRenamed({str(i): f"d{i}" for i in range(10)})


@JOBS.add(NEAR + "SELECT q_label, label, round(min(dist), 4) AS dist FROM r GROUP BY q_label, label")
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for any number of labels: a row for each pair of them."""
    e = table(spark, sf_dir, "embeddings")
    known = e.agg(F.collect_set("label").alias("known"))
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding", F.col("label").alias("q_label"))
    spread = asked.join(F.broadcast(known), F.lit(True)).select("vec_id", "embedding", F.explode("known").alias("label"))
    found = V.knn(e, spread, 1, by="label").join(asked.select(F.col("vec_id").alias("query_id"), "q_label"), "query_id")
    return found.groupBy("q_label", "label").agg(F.round(F.min("dist"), 4).alias("dist"))
