"""Key phrase queries: every stage over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.base import Jobs, table
from millrace.jobs.texts import SENTENCES
from millrace.operators import keyphrase as K

JOBS = Jobs()

_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
TOKENS = (
    r"""
WITH sents AS (SELECT doc_id, """ + SENTENCES + r""" AS s FROM documents),
sx AS (SELECT doc_id, unnest(range(len(s))) AS sent, unnest(s) AS txt FROM sents),
tl AS (SELECT doc_id, sent, regexp_extract_all(txt, '[\p{L}\p{N}_-]+|[^\s\p{L}\p{N}_-]+') AS w FROM sx),
tx AS (SELECT doc_id, sent, unnest(range(len(w))) AS pos, unnest(w) AS word FROM tl),
tm AS (SELECT *, regexp_full_match(word, '[!-/:-@\[-`{-~]+') AS mark FROM tx),
tb AS (SELECT *, sum(mark::INTEGER) OVER w AS block, sum((NOT mark)::INTEGER) OVER w - 1 AS place FROM tm WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)),
tk AS (SELECT doc_id, sent, pos, block, place, word, lower(word) AS low,
  CASE WHEN regexp_full_match(regexp_replace(regexp_replace(word, ',', '', 'g'), '^([^.]*)\.([^.]*)$', '\1\2'), '\p{Nd}+') THEN 'd'
    WHEN (regexp_matches(word, '\p{Nd}') AND regexp_matches(word, '\p{L}')) OR (NOT regexp_matches(word, '\p{Nd}') AND NOT regexp_matches(word, '\p{L}'))
      OR length(word) - length(regexp_replace(word, '[!-/:-@\[-`{-~]', '', 'g')) > 1 THEN 'u'
    WHEN regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '\p{Ll}') THEN 'a'
    WHEN length(word) > 1 AND place > 0 AND regexp_full_match(word, '\p{Lu}[^\p{Lu}]*') THEN 'n' ELSE 'p' END AS tag FROM tb WHERE NOT mark),
tokens AS (SELECT *, CASE WHEN length(low) > 3 AND low LIKE '%s' THEN substr(low, 1, length(low) - 1) ELSE low END AS term FROM tk),
terms AS (SELECT doc_id, term, count(*) AS tf, count(*) FILTER (WHERE tag = 'a') AS tf_a, count(*) FILTER (WHERE tag = 'n') AS tf_n,
  count(DISTINCT sent) AS n_sents, median(DISTINCT sent)::DOUBLE AS median_sent,
  arg_min(low IN (""" + _STOP + r""") OR term IN (""" + _STOP + r""") OR length(regexp_replace(term, '[!-/:-@\[-`{-~]', '', 'g')) < 3, (sent, pos)) AS stop FROM tokens GROUP BY doc_id, term),
lagged AS (SELECT doc_id, lag(term) OVER w AS a, lag(tag) OVER w AS a_tag, term AS b, tag FROM tokens WINDOW w AS (PARTITION BY doc_id, sent, block ORDER BY pos)),
edges AS (SELECT doc_id, a, b, count(*) AS weight FROM lagged WHERE a IS NOT NULL AND a_tag NOT IN ('u', 'd') AND tag NOT IN ('u', 'd') GROUP BY doc_id, a, b),
deg AS (SELECT doc_id, term, CASE WHEN sum(lw) > 0 THEN sum(l) / sum(lw) ELSE 0.0 END AS pwl, CASE WHEN sum(rw) > 0 THEN sum(r) / sum(rw) ELSE 0.0 END AS pwr FROM (
  SELECT doc_id, b AS term, 1 AS l, weight AS lw, 0 AS r, 0 AS rw FROM edges UNION ALL SELECT doc_id, a, 0, 0, 1, weight FROM edges) GROUP BY doc_id, term),
stats AS (SELECT doc_id, avg(CASE WHEN NOT stop THEN tf END) AS mean, stddev_pop(CASE WHEN NOT stop THEN tf END) AS std, max(tf) AS top FROM terms GROUP BY doc_id),
j AS (SELECT t.*, mean, std, top, len(s.s) AS all_sents, coalesce(pwl, 0.0) AS pwl, coalesce(pwr, 0.0) AS pwr
  FROM terms t JOIN stats USING (doc_id) JOIN sents s USING (doc_id) LEFT JOIN deg USING (doc_id, term)),
rel AS (SELECT *, (0.5 + pwl * tf / top) + (0.5 + pwr * tf / top) AS rel FROM j),
und AS (SELECT *, greatest(tf_a, tf_n) / (1 + ln(tf)) + tf / (mean + std) / rel + (n_sents / all_sents) / rel AS under FROM rel),
h AS (SELECT doc_id, term, tf, stop, CASE WHEN mean IS NULL OR under = 0 THEN 0.0 ELSE ln(ln(3 + median_sent)) * rel / under END AS h FROM und)
"""
)
GRAMS = r""", gw AS (SELECT doc_id, sent, pos, lag(word, 2) OVER w AS w0, lag(term, 2) OVER w AS t0, lag(tag, 2) OVER w AS g0,
  lag(word) OVER w AS w1, lag(term) OVER w AS t1, lag(tag) OVER w AS g1, word AS w2, term AS t2, tag AS g2 FROM tokens WINDOW w AS (PARTITION BY doc_id, sent, block ORDER BY pos)),
gr AS (SELECT doc_id, sent, pos, 1 AS n, lower(w2) AS key, t2 AS t0, NULL AS t1, NULL AS t2, g2 AS tags FROM gw
  UNION ALL SELECT doc_id, sent, pos, 2, lower(w1 || ' ' || w2), t1, t2, NULL, g1 || g2 FROM gw WHERE w1 IS NOT NULL
  UNION ALL SELECT doc_id, sent, pos, 3, lower(w0 || ' ' || w1 || ' ' || w2), t0, t1, t2, g0 || g1 || g2 FROM gw WHERE w0 IS NOT NULL),
cand AS (SELECT doc_id, key, arg_min({'n': n, 't0': t0, 't1': t1, 't2': t2}, (sent, pos)) AS x, count(*) AS tf FROM gr GROUP BY doc_id, key HAVING max(NOT regexp_matches(tags, '[ud]')))
"""
SCORES = GRAMS + r""", c AS (SELECT doc_id, key, x.n AS n, x.t0 AS t0, x.t1 AS t1, x.t2 AS t2, tf FROM cand),
k AS (SELECT c.*, a.h AS h0, b.h AS h1, d.h AS h2, b.stop AS stop1, coalesce(e.weight / a.tf, 0.0) * coalesce(f.weight / d.tf, 0.0) AS p, n = 3 AND b.stop AS bridged
  FROM c JOIN h a ON a.doc_id = c.doc_id AND a.term = c.t0 LEFT JOIN h b ON b.doc_id = c.doc_id AND b.term = c.t1 LEFT JOIN h d ON d.doc_id = c.doc_id AND d.term = c.t2
  LEFT JOIN edges e ON e.doc_id = c.doc_id AND e.a = c.t0 AND e.b = c.t1 LEFT JOIN edges f ON f.doc_id = c.doc_id AND f.a = c.t1 AND f.b = c.t2
  WHERE NOT a.stop AND NOT CASE n WHEN 1 THEN a.stop WHEN 2 THEN b.stop ELSE d.stop END),
v AS (SELECT *, (h0 + CASE WHEN bridged THEN -(1 - p) ELSE coalesce(h1, 0.0) END + coalesce(h2, 0.0) + 1) * tf AS under,
  h0 * CASE WHEN n < 2 THEN 1.0 WHEN bridged THEN 2 - p ELSE h1 END * CASE WHEN n < 3 THEN 1.0 ELSE h2 END AS prod FROM k)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@JOBS.add(TOKENS + "SELECT doc_id, term, tf, tf_a, tf_n, n_sents, median_sent, stop FROM terms")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.terms(K.tokens(_docs(spark, sf_dir)))


@JOBS.add(TOKENS + "SELECT a, b, sum(weight)::BIGINT AS weight, count(*) AS docs FROM edges GROUP BY a, b")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.edges(K.tokens(_docs(spark, sf_dir)))
    return e.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("docs"))


@JOBS.add(TOKENS + "SELECT doc_id, term, round(pwl, 6) AS pwl, round(pwr, 6) AS pwr FROM deg")
def degree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.degrees(K.edges(K.tokens(_docs(spark, sf_dir))))
    return d.select("doc_id", "term", F.round("pwl", 6).alias("pwl"), F.round("pwr", 6).alias("pwr"))


@JOBS.add(TOKENS + "SELECT doc_id, term, tf, stop, round(h, 5) AS h FROM h")
def term_scores_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scored_terms(_docs(spark, sf_dir)).withColumn("h", F.round("h", 5))


@JOBS.add(TOKENS + GRAMS + "SELECT x.n::INTEGER AS n, count(*) AS candidates, sum(tf)::BIGINT AS occurrences, count(DISTINCT key) AS keys FROM cand GROUP BY x.n")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.phrase_counts(_docs(spark, sf_dir))
    return c.groupBy("n").agg(F.sum("docs").alias("candidates"), F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("keys"))


@JOBS.add(TOKENS + SCORES + "SELECT doc_id, key, n::INTEGER AS n, tf, round(under, 5) AS under, round(CASE WHEN under > 0.01 THEN prod / under END, 4) AS s FROM v")
def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases with the denominators of their scores, and the scores; these are null where the denominator is near 0 or below it."""
    s = K.phrase_scores(_docs(spark, sf_dir), with_denominator=True)
    rounded = lambda c, digits: F.floor(c * 10.0**digits + 0.5) / 10.0**digits  # noqa: E731  of what is never below 0, in doubles: F.round goes through decimals
    return s.select("doc_id", "key", "n", "tf", rounded(F.col("under"), 5).alias("under"), rounded(F.when(F.col("under") > 0.01, F.col("s")), 4).alias("s"))


@JOBS.add()
def yake_keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.key_phrases(_docs(spark, sf_dir))
