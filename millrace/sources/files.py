"""Readers and writers of workspace files: documents, skills, knowledge, word lists, logs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.functions import text as X


def scan(spark: SparkSession, root: str, ignore: list[tuple[str, str]] = ()) -> DataFrame:
    """(path below the root, mtime in seconds, size, content): files that aren't empty or ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.substring_index("path", f"{base}/", -1)
    rows = files.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.where((F.col("size") > 0) & ~P.is_ignored(F.col("path"), list(ignore)))


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of the files that are UTF-8; others are left out."""
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "mtime", "size", valid.alias("text")).where("text IS NOT NULL")


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", "mtime", "size")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Stems of a dictionary file: the first line is a count, entries are cut at a slash."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where("n > 0")
    word = F.lower(F.trim(F.split("line", "/")[0]))
    return rows.select(word.alias("word")).where("word <> ''").select(X.stem(F.col("word")).alias("stem")).distinct()


def skills(texts: DataFrame) -> DataFrame:
    """Skill files (path, text): headers before INSTRUCTION:, the prompt after it, calls after TOOL_CALLS:."""
    head, rest = F.substring_index("text", "INSTRUCTION:", 1), F.regexp_extract("text", "(?s)INSTRUCTION:(.*)$", 1)
    field = lambda name: F.trim(F.regexp_extract(head, f"(?m)^{name}:(.*)$", 1))
    number = lambda r: F.coalesce(F.regexp_extract(field("STATS"), r, 1).try_cast("int"), F.lit(0))
    entities = F.filter(F.transform(F.split(field("ENTITIES"), ","), lambda e: F.lower(F.trim(e))), lambda e: e != "")
    return texts.where(F.col("path").endswith(".md")).select(
        F.element_at(F.split("path", "/"), -1).alias("skill_file"),
        field("AGENT").alias("agent_name"),
        field("FOR").alias("description"),
        F.regexp_replace(F.substring_index(rest, "TOOL_CALLS:", 1), "^\\s+|\\s+$", "").alias("prompt"),
        entities.alias("entities"),
        number("success=(\\d+)").alias("success_count"),
        number("fail=(\\d+)").alias("fail_count"),
        X.tool_calls(F.col("text")).alias("tool_calls"),
    )


def skill_phrases(skills: DataFrame, phrases: Column) -> DataFrame:
    """(skill_file, n, phrase): one index row for each phrase, of two words at least."""
    rows = skills.select("skill_file", F.posexplode(phrases).alias("n", "phrase"))
    return rows.where(F.size(F.split(F.trim("phrase"), "\\s+")) >= 2)


def knowledge(texts: DataFrame) -> DataFrame:
    """(name, description, body) of the files with a whole front matter and a valid name."""
    rows = texts.where(F.col("path").endswith(".md")).select(X.frontmatter(F.col("text")).alias("f")).where("f IS NOT NULL").select("f.*")
    return rows.where(P.is_valid_id(F.col("name"))).orderBy("name")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """(clock, role, text) of lines [HH:MM:SS] role: text."""
    line = "^\\[(\\d{2}:\\d{2}:\\d{2})\\] ([^:]+): (.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(*(F.regexp_extract("value", line, i + 1).alias(c) for i, c in enumerate(("clock", "role", "text"))))


def json_index(rows: DataFrame, by: str, path: str) -> None:
    """One JSON document for each value of ``by``, with its rows nested, as text files."""
    rest = [c for c in rows.columns if c != by]
    nested = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    nested.select(F.to_json(F.struct(by, "items")).alias("value")).write.mode("overwrite").text(path)
