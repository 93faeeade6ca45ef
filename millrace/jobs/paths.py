"""Path queries over the pages' addresses, and snapshot differences over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.jobs.base import Jobs, table

JOBS = Jobs()

PATHS = r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS seg FROM p)"
PATTERNS = P.parse_ignore("# hosts and pages\nblog.*\n9?\n\n/*.net/de\n")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@JOBS.add(PATHS + """, x AS (SELECT seg[1] AS host, seg[2] AS name, len(seg) AS n FROM s WHERE len(seg) > 1)
SELECT host, name, CASE WHEN max(n) > 2 THEN 'dir' ELSE 'file' END AS kind, count(*) AS n FROM x GROUP BY host, name""")
def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries right below each host."""
    s = P.segments(F.col("path"))
    rows = _paths(spark, sf_dir).select(s.alias("s")).where("size(s) > 1").select(F.col("s")[0].alias("host"), F.col("s")[1].alias("name"), F.size("s").alias("k"))
    return rows.groupBy("host", "name").agg(F.when(F.max("k") > 2, "dir").otherwise("file").alias("kind"), F.count(F.lit(1)).alias("n"))


@JOBS.add(PATHS + """, x AS (SELECT unnest(list_transform(range(1, len(seg) + 1), lambda i: array_to_string(seg[1:i], '/'))) AS path FROM s)
SELECT path, count(*) AS n FROM x GROUP BY path""")
def path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directories and files, with the number of pages below."""
    rows = _paths(spark, sf_dir).select(F.explode(P.prefixes(F.col("path"))).alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@JOBS.add(PATHS + "SELECT page_id, path FROM s WHERE contains(seg[len(seg)], '7')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(F.element_at(P.segments(F.col("path")), -1).contains("7"))


@JOBS.add(PATHS + r"""SELECT page_id, len(list_filter(seg, lambda x: regexp_full_match(x, 'blog\.[^/]*') OR regexp_full_match(x, '9[^/]'))) > 0
  OR regexp_full_match(array_to_string(seg[1:2], '/'), '[^/]*\.net/de') AS ignored FROM s""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", P.is_ignored(F.col("path"), PATTERNS).alias("ignored"))


@JOBS.add(PATHS + r"SELECT page_id, path FROM s WHERE regexp_full_match(array_to_string(seg, '/'), '[^/]*\.example\.[^/]*/en/[^/][^/]')")
def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(P.segments(F.col("path")), "/")
    return _paths(spark, sf_dir).where(joined.rlike(P.glob_regex("*.example.*/en/??")))


@JOBS.add(r"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '/../x' WHEN 1 THEN '/' || source || '/./' || lang WHEN 2 THEN source || '/.About' WHEN 3 THEN source || '/.storageignore/x' ELSE source || '/' || doc_id END AS path FROM documents)
SELECT doc_id, len(list_filter(string_split(path, '/'), lambda x: x = '..' OR lower(x) IN ('.about', '.summary', '.skills', '.knowledge', '.rebukes', '.tools', '.storageignore', 'vector_meta.json'))) = 0 AS safe,
  regexp_full_match(split_part(path, '/', 1), '[A-Za-z0-9_-]+') AS valid_id FROM p""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, source = F.col("doc_id") % 5, F.col("source")
    path = (
        F.when(k == 0, F.concat(source, F.lit("/../x"))).when(k == 1, F.concat(F.lit("/"), source, F.lit("/./"), F.col("lang")))
        .when(k == 2, F.concat(source, F.lit("/.About"))).when(k == 3, F.concat(source, F.lit("/.storageignore/x")))
        .otherwise(F.concat(source, F.lit("/"), F.col("doc_id").cast("string")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", P.is_safe(F.col("path")).alias("safe"), P.is_valid_id(F.split("path", "/")[0]).alias("valid_id"))


SNAPSHOTS = """WITH i AS (SELECT source || '/' || doc_id AS path, doc_id AS mtime, n_chars AS size FROM documents WHERE doc_id % 11 <> 3),
d AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 2 THEN doc_id + 1 ELSE doc_id END AS mtime, CASE WHEN doc_id % 13 = 5 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 17 <> 4),
x AS (SELECT coalesce(d.path, i.path) AS path, d.mtime AS dm, d.size AS ds, i.mtime AS im, i.size AS isz, CASE WHEN i.path IS NULL THEN 'add' WHEN d.path IS NULL THEN 'remove'
  WHEN d.mtime <> i.mtime OR d.size <> i.size THEN 'replace' ELSE 'keep' END AS action FROM d FULL JOIN i ON d.path = i.path)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the index holds and what is found on disk: documents, some gone, some new, some changed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "n_chars")
    k = F.col("doc_id")
    index = rows.where(k % 11 != 3).select("path", k.alias("mtime"), F.col("n_chars").alias("size"))
    disk = rows.where(k % 17 != 4).select("path", F.when(k % 7 == 2, k + 1).otherwise(k).alias("mtime"), F.when(k % 13 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"))
    return disk, index


@JOBS.add(SNAPSHOTS + "SELECT path, action FROM x")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, index = _snapshots(spark, sf_dir)
    return P.snapshot_diff(disk, index, "mtime", "size")


@JOBS.add(SNAPSHOTS + "SELECT path, coalesce(dm, im) AS mtime, coalesce(ds, isz) AS size FROM x WHERE action <> 'remove'")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a refresh: what is gone is removed, what is new or changed is put in."""
    disk, index = _snapshots(spark, sf_dir)
    actions = P.snapshot_diff(disk, index, "mtime", "size")
    changed = disk.join(actions.where("action IN ('add', 'replace')"), "path", "left_semi")
    kept = index.join(actions.where("action = 'remove'"), "path", "left_anti")
    return P.upsert(kept, changed, "path")


@JOBS.add(SNAPSHOTS + "SELECT d.path, d.size FROM d WHERE EXISTS (SELECT 1 FROM i WHERE i.path = d.path AND i.mtime = d.mtime AND i.size = d.size)")
def index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a stored index that still describe what is on disk."""
    disk, index = _snapshots(spark, sf_dir)
    return disk.join(index, ["path", "mtime", "size"], "left_semi").select("path", "size")


@JOBS.add("""SELECT page_id, page_id % 4 IN (1, 2) AS pruned, page_id % 3 = 1 AND page_id % 4 <> 0 AS excluded FROM pages""")
def source_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in directories that a walk over sources doesn't enter, and files that a list of patterns excludes."""
    k, n = F.col("page_id") % 4, F.col("page_id") % 3
    folder = F.when(k == 0, "target").when(k == 1, "a/node_modules/b/").when(k == 2, ".git/").otherwise("src/bin.d/")
    name = F.when(k == 0, "").when(n == 1, "x.log").otherwise("bin")
    patterns = [("name", x) for x in P.parse_gitignore("# logs\n\n*.log\n!keep.log\n/*.log/\n")]
    path = F.concat(folder, name)
    return table(spark, sf_dir, "pages").select("page_id", P.is_pruned(path).alias("pruned"), P.is_ignored(path, patterns).alias("excluded"))
