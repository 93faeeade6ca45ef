"""The index of four corpora made of the given tables: built, written, read back against what is on disk now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.base import Jobs, shared_folder, table
from millrace.operators import index as I

JOBS = Jobs()

FILES = r"""WITH f AS (SELECT 'projects' AS corpus, coalesce(source, '') || '/' || doc_id AS path, doc_id AS id, text FROM documents
UNION ALL SELECT 'skills', conv_id || '/' || turn, conv_id, text FROM conversations UNION ALL SELECT 'knowledge', 'k/' || item_id, item_id, text FROM benchmark
UNION ALL SELECT 'tools', 't/' || page_id, page_id, html FROM pages),
g AS (SELECT corpus, path, text, strlen(text)::BIGINT AS size FROM f WHERE id % 9 <> 4 AND strlen(text) > 0 AND (strlen(text) <= 512 OR regexp_matches(text, '\S')))
"""


def _corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    def files(name: str, path: Column, key: str, text: str) -> DataFrame:
        size = F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")
        return table(spark, sf_dir, name).select(path.alias("path"), F.col(key).cast("bigint").alias("mtime"), size.alias("size"), F.col(text).alias("text"))

    text = lambda c: F.col(c).cast("string")
    return I.together({
        "projects": files("documents", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), text("doc_id")), "doc_id", "text"),
        "skills": files("conversations", F.concat(text("conv_id"), F.lit("/"), text("turn")), "conv_id", "text"),
        "knowledge": files("benchmark", F.concat(F.lit("k/"), text("item_id")), "item_id", "text"),
        "tools": files("pages", F.concat(F.lit("t/"), text("page_id")), "page_id", "html"),
    })


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are indexed; then every ninth one changes on disk."""
    files, path = _corpora(spark, sf_dir), shared_folder(spark, "index")
    I.build(files, path)
    return I.load(spark, path, files.withColumn("mtime", F.when(F.col("mtime") % 9 == 4, -1).otherwise(F.col("mtime"))))


@JOBS.add(FILES + "SELECT DISTINCT corpus, path, size FROM g")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the stored index describes as they are."""
    return _loaded(spark, sf_dir).select("corpus", "path", "size").distinct()


@JOBS.add(FILES + "SELECT corpus, count(DISTINCT path) AS files, count(DISTINCT path) AS firsts FROM g GROUP BY corpus")
def index_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each corpus in the stored index, and how many have a first chunk with a vector of length 1 that starts their text."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    first = (F.col("idx") == 0) & (F.col("end_byte") > F.col("start_byte")) & ((F.abs(norm - 1) < 1e-9) | (F.trim("chunk") == ""))
    rows = _loaded(spark, sf_dir).groupBy("corpus", "path").agg(F.max(first.cast("int")).alias("f"))
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("f").cast("bigint")).alias("firsts"))


SYNC = r"""WITH f AS (SELECT 'projects' AS corpus, coalesce(source, '') || '/' || doc_id AS path, doc_id AS id, text FROM documents
UNION ALL SELECT 'skills', conv_id || '/' || turn, conv_id, text FROM conversations UNION ALL SELECT 'knowledge', 'k/' || item_id, item_id, text FROM benchmark
UNION ALL SELECT 'tools', 't/' || page_id, page_id, html FROM pages),
g AS (SELECT corpus, path, id AS mtime, coalesce(id % 251 = 3, false) AS two, coalesce(id % 257 = 5, false) AS gone, coalesce(id % 263 = 9, false) AS three FROM f
  WHERE strlen(text) > 0 AND (strlen(text) <= 512 OR regexp_matches(text, '\S'))),
n AS (SELECT 'notes' AS corpus, 'n/' || item_id AS path, item_id AS mtime, item_id % 80 = 7 AS gone FROM benchmark WHERE item_id % 40 = 7 AND strlen(text) > 0),
e AS (SELECT corpus, path, mtime + CASE WHEN two THEN 1000000 ELSE 0 END + CASE WHEN three THEN 2000000 ELSE 0 END AS mtime, NOT gone AS stays,
    CASE WHEN three AND NOT gone THEN 3 WHEN two OR gone THEN 2 ELSE 1 END AS touched FROM g
  UNION ALL SELECT corpus, path, mtime, NOT gone, CASE WHEN gone THEN 3 ELSE 2 END FROM n),
b AS (SELECT *, ('0x' || substr(md5(corpus || '/' || path), 1, 8))::BIGINT % 64 AS bucket FROM e)
SELECT corpus, path, mtime, written FROM (SELECT *, max(touched) OVER (PARTITION BY bucket)::BIGINT AS written FROM b) WHERE stays
"""


@JOBS.add(SYNC)
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the index after three rounds of changes on disk, and the version that wrote their bucket last: others stay as they are."""
    first = _corpora(spark, sf_dir)
    notes = table(spark, sf_dir, "benchmark").where("item_id % 40 = 7")
    notes = I.together({"notes": notes.select(F.concat(F.lit("n/"), F.col("item_id").cast("string")).alias("path"), F.col("item_id").cast("bigint").alias("mtime"), F.octet_length("text").cast("bigint").alias("size"), "text")})
    later = lambda rows, every, at, by: rows.withColumn("mtime", F.when(F.col("id") % every == at, F.col("mtime") + by).otherwise(F.col("mtime")))
    known = first.withColumn("id", F.col("mtime"))
    second = later(known, 251, 3, 1_000_000).where("NOT coalesce(id % 257 = 5, false)")
    third = later(second, 263, 9, 2_000_000)
    store = I.Store(spark, shared_folder(spark, "index"))
    for disk in (first, second.drop("id").unionByName(notes), third.drop("id").unionByName(notes.where("mtime % 80 <> 7"))):
        store.sync(disk)
        store.vacuum()  # nothing reads an older version
    bucket = I.bucket_of(F.col("corpus"), F.col("path"), I.BUCKETS)
    rows = store.rows().where("idx = 0").select("corpus", "path", "mtime", bucket.alias("bucket"))
    return rows.join(F.broadcast(store.written()), "bucket").select("corpus", "path", "mtime", F.col("version").alias("written"))
