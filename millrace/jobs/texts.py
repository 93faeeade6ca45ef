"""Queries on texts of documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.shared import written
from millrace.jobs.base import Jobs, table
from millrace.operators.mentions import mentions

JOBS = Jobs()

SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '),
  '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+')"
WORD_SET = r"list_filter(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\s+')), lambda x: x <> '')"
COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@JOBS.add(f"SELECT doc_id, len(s)::INTEGER AS n_sentences, length(s[1])::INTEGER AS first_length FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.length(F.get("s", F.lit(0))).alias("first_length"))


@JOBS.add(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) GROUP BY word")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("word"))
    per_doc = rows.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@JOBS.add(r"""WITH w AS (SELECT lang, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT lang, """ + WORDS + r""" AS w FROM documents)),
t AS (SELECT lang, word, place, regexp_matches(word, '\p{Nd}') AS dig, regexp_matches(word, '\p{L}') AS let FROM w)
SELECT lang, CASE WHEN regexp_full_match(word, '\p{Nd}+') THEN 'd'
  WHEN (dig AND let) OR (NOT dig AND NOT let) OR length(word) - length(regexp_replace(word, '[_-]', '', 'g')) > 1 THEN 'u'
  WHEN regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '\p{Ll}') THEN 'a'
  WHEN length(word) > 1 AND place > 0 AND regexp_full_match(word, '\p{Lu}[^\p{Lu}]*') THEN 'n' ELSE 'p' END AS tag, count(*) AS n
FROM t GROUP BY ALL""")
def word_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.posexplode(X.words(F.col("text"))).alias("place", "word"))
    return rows.groupBy("lang", X.tag(F.col("word"), F.col("place")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@JOBS.add(f"""WITH b AS (SELECT DISTINCT unnest({WORD_SET}) AS word FROM benchmark),
d AS (SELECT doc_id, unnest({WORD_SET}) AS word FROM documents)
SELECT doc_id, count(*) AS common FROM d JOIN b USING (word) GROUP BY doc_id""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a word with any of the phrases, and how many."""
    phrases = table(spark, sf_dir, "benchmark").select(F.explode(X.word_set(F.col("text"))).alias("word")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.word_set(F.col("text"))).alias("word"))
    return rows.join(phrases, "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("common"))


@JOBS.add(f"""SELECT fp, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(lower({COLLAPSED.format("coalesce(text, '')")})) AS fp FROM documents)
GROUP BY fp HAVING count(*) > 1""")
def fingerprint_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    return rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@JOBS.add(f"""WITH f AS (SELECT doc_id, source, sha256(lower({COLLAPSED.format("coalesce(text, '')")})) AS fp FROM documents)
SELECT a.doc_id, a.source FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.source = a.source AND b.fp = a.fp AND b.doc_id < a.doc_id)""")
def duplicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored if a record of the same source and fingerprint is refused."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", X.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    return rows.groupBy("source", "fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@JOBS.add(r"""WITH lex AS (SELECT list(DISTINCT lower(w)) AS known FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) AS w FROM benchmark)),
t AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '"[^"]*"|"[^"]*\z|[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*') AS w FROM documents)),
k AS (SELECT t.*, starts_with(w, '"') OR NOT list_contains(known, lower(w)) AS ent FROM t, lex)
SELECT doc_id, sha256(lower(string_agg(CASE WHEN ent THEN '<ENT>' ELSE w END, ' ' ORDER BY i))) AS fp,
  count(*) FILTER (WHERE ent)::INTEGER AS n_entities, count(*)::INTEGER AS n_tokens FROM k GROUP BY doc_id""")
def entity_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts; the words of the benchmark are the lexicon. Known words are looked up by a join, not in an array."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("low")).distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lexer(F.coalesce("text", F.lit("")))).alias("i", "w"))
    rows = rows.withColumn("low", F.lower("w")).join(known, "low", "left")
    rows = rows.withColumn("ent", F.col("w").startswith('"') | F.col("known").isNull())
    shown = F.struct("i", F.when(F.col("ent"), "<ENT>").otherwise(F.col("w")).alias("w"))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(shown)).alias("p"), F.sum(F.col("ent").cast("int")).cast("int").alias("n_entities"), F.count(F.lit(1)).cast("int").alias("n_tokens"))
    return out.select("doc_id", X.fingerprint(F.array_join(F.transform("p", lambda x: x["w"]), " ")).alias("fp"), "n_entities", "n_tokens")


@JOBS.add(r"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS e FROM benchmark),
e AS (SELECT item_id, len(e) AS n, unnest(e) AS word FROM q),
d AS (SELECT doc_id, unnest(""" + WORD_SET + r""") AS word FROM documents)
SELECT item_id, doc_id FROM e JOIN d USING (word) GROUP BY item_id, doc_id, n HAVING count(*) = n""")
def entities_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: documents that hold every word of an item. Only those that hold its rarest word are looked at.

    The words of documents are never broadcast: their files are a small part of what they take in memory.
    """
    e = table(spark, sf_dir, "benchmark").select("item_id", X.word_set(F.col("text")).alias("e"))
    e = e.select("item_id", F.size("e").alias("n"), F.explode("e").alias("word"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.word_set(F.col("text"))).alias("word"))
    d = written(d.join(e.select("word").distinct(), "word", "left_semi"), "words")
    held = d.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    rarest = e.join(held, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)), "word"))["word"].alias("word"))
    near = rarest.join(d.hint("merge"), "word").select("item_id", "doc_id")
    found = near.join(e, "item_id").join(d.hint("merge"), ["doc_id", "word"]).groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("found"))
    return found.where("found = n").select("item_id", "doc_id")


FRONT = r"""SELECT item_id, '---' || chr(10) || 'name: item_' || item_id || chr(10) || 'description: ' || (CASE WHEN item_id % 7 = 0 THEN '' ELSE split_part(text, ' ', 1) END)
  || chr(10) || (CASE WHEN item_id % 5 = 0 THEN '' ELSE '---' || chr(10) END) || text AS content FROM benchmark"""


@JOBS.add("WITH c AS (" + FRONT + r"""), p AS (SELECT item_id, regexp_extract(content, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n(.*)$', ['b', 'body']) AS m FROM c)
SELECT item_id, regexp_extract(m.b, 'name: ([^\n]*)', 1) AS name, trim(regexp_extract(m.b, 'description:[ \t]*([^\n]*)', 1)) AS description, m.body AS body
FROM p WHERE m.b <> '' AND trim(regexp_extract(m.b, 'description:[ \t]*([^\n]*)', 1)) <> ''""")
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge files made of the benchmark; broken ones (no description, not closed) are skipped."""
    b = table(spark, sf_dir, "benchmark")
    first = F.when(F.col("item_id") % 7 == 0, "").otherwise(F.split("text", " ")[0])
    close = F.when(F.col("item_id") % 5 == 0, "").otherwise("---\n")
    content = F.concat(F.lit("---\nname: item_"), F.col("item_id").cast("string"), F.lit("\ndescription: "), first, F.lit("\n"), close, F.col("text"))
    return b.select("item_id", X.frontmatter(content).alias("f")).where("f IS NOT NULL").select("item_id", "f.*")


@JOBS.add(r"""SELECT item_id, 1::INTEGER AS n_calls, 'tool_' || (item_id % 4) AS first_name,
  '1. tool_' || (item_id % 4) || ' ' || (CASE WHEN strlen(a) > 200 THEN substr(a, 1, 200) || '...' ELSE a END) AS shown
FROM (SELECT item_id, '{"q":"' || regexp_replace(text, '["\\\n]', ' ', 'g') || '"}' AS a FROM benchmark) WHERE item_id % 6 <> 0""")
def toolcall_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded calls made of the benchmark; those cut off in the middle are dropped."""
    b = table(spark, sf_dir, "benchmark")
    argument = F.concat(F.lit('{"q":"'), F.regexp_replace("text", '["\\\\\\n]', " "), F.lit('"}'))
    close = F.when(F.col("item_id") % 6 == 0, "").otherwise("}]")
    content = F.concat(F.col("text"), F.lit('\nTOOL_CALLS: [{"name":"tool_'), (F.col("item_id") % 4).cast("string"), F.lit('","arguments":'), argument, close)
    calls = b.select("item_id", X.tool_calls(content).alias("c")).where("c IS NOT NULL AND size(c) > 0 AND c[0].arguments IS NOT NULL")
    return calls.select("item_id", F.size("c").alias("n_calls"), F.col("c")[0]["name"].alias("first_name"), X.injection(F.col("c")).alias("shown"))


@JOBS.add("""SELECT doc_id, strlen(coalesce(text, '')) AS n, CASE WHEN strlen(coalesce(text, '')) < 1024 THEN strlen(coalesce(text, '')) || ' B'
  WHEN strlen(coalesce(text, '')) < 1048576 THEN printf('%.1f KB', strlen(coalesce(text, '')) / 1024.0) ELSE printf('%.2f MB', strlen(coalesce(text, '')) / 1048576.0) END AS shown FROM documents""")
def formatted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), X.format_bytes(n).alias("shown"))


@JOBS.add(r"""SELECT doc_id, lower(regexp_replace(source || ' ' || lang || '/' || doc_id, '[^\p{L}\p{N}]', '_', 'g')) AS name FROM documents""")
def skill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", X.skill_name(title).alias("name"))


@JOBS.add(r"""WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) AS w FROM benchmark),
w AS (SELECT DISTINCT item_id, lower(w) AS w FROM p WHERE regexp_full_match(w, '[A-Za-z]{5,}')),
b AS (SELECT a.item_id AS a_id, b.item_id AS b_id, a.w AS a, b.w AS b, CASE WHEN a.w = b.w THEN 1.0 ELSE 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) END AS s
  FROM w a JOIN w b ON a.item_id < b.item_id AND substr(a.w, 1, 4) = substr(b.w, 1, 4))
SELECT a_id, b_id, round(max(s), 6) AS best, count(*) AS n FROM b WHERE s > 0.8 GROUP BY a_id, b_id""")
def phrase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like words of two items by edit distance, among those with the same first four letters."""
    p = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.words(F.col("text"))).alias("w")).where(F.col("w").rlike("^[A-Za-z]{5,}$"))
    p = p.select("item_id", F.lower("w").alias("w")).distinct().withColumn("start", F.substring("w", 1, 4))
    a, b = p.withColumnsRenamed({"item_id": "a_id", "w": "a"}), p.withColumnsRenamed({"item_id": "b_id", "w": "b"})
    both = a.join(b, "start").where("a_id < b_id").withColumn("s", X.similarity(F.col("a"), F.col("b"))).where("s > 0.8")
    return both.groupBy("a_id", "b_id").agg(F.round(F.max("s"), 6).alias("best"), F.count(F.lit(1)).alias("n"))


@JOBS.add("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_name || ' ' || p_brand || ' ' || p_type AS description FROM part),
w AS (SELECT DISTINCT split_part(name, ' ', 1) AS name FROM n)
SELECT w.name, count(*) AS mentions FROM w JOIN n ON contains(n.description, w.name) GROUP BY w.name""")
def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many descriptions mention each of the distinct names as a substring."""
    n = table(spark, sf_dir, "part")
    description = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    found = mentions(n.select(description.alias("text")), n.select(F.split("p_name", " ")[0].alias("name")))
    return found.groupBy("name").agg(F.sum("n").alias("mentions"))


@JOBS.add(r"""SELECT page_id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE 'http://' || u END AS url
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM pages)""")
def ensured_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.ensure_scheme(u).alias("url"))
