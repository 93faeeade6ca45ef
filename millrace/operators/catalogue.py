"""Catalogues as logs of puts and deletes: the last valid operation on a key decides; index rows follow their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.running import parts

from millrace.functions import text as X
from millrace.sources.files import skill_phrases

PUT, DELETE = "put", "delete"


def current(log: DataFrame, key: str, at: str, valid: Column) -> DataFrame:
    """The rows of ``log`` (op, key, at, ...) that stand: for each key its last valid operation, if that is a put.

    An operation that isn't valid, or has a null key, is refused and changes nothing. Operations of one key have
    different ``at``. The maximum is taken before the shuffle, so a key with many operations sends one row a task.
    """
    rest = [c for c in log.columns if c not in (key, at)]
    rows = log.where(valid & F.col(key).isNotNull() & F.col("op").isin(PUT, DELETE))
    last = rows.groupBy(key).agg(F.max_by(F.struct(at, *rest), F.col(at)).alias("x"))
    return last.select(key, "x.*").where(F.col("op") == PUT).select(*log.columns).drop("op")


def skills(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skill files (skill_file, seq, phrases) and their index rows (skill_file, n, phrase, path) after a log of (op, skill_file, seq, phrases).

    A put replaces the index rows of the puts before it, a delete takes file and rows; names that don't end in .md are refused.
    """
    files = current(log, "skill_file", "seq", F.col("skill_file").endswith(".md"))
    rows = skill_phrases(files, F.coalesce("phrases", F.array().cast("array<string>")))
    path = F.concat(F.regexp_replace("skill_file", "\\.md$", ""), F.lit("_index_"), F.col("n").cast("string"), F.lit(".idx"))
    return files, rows.withColumn("path", path)


def knowledge(log: DataFrame) -> DataFrame:
    """(name, seq, description, body) after a log of (op, name, seq, content); a put whose front matter has another name, or is broken, is refused."""
    matter = log.withColumn("f", F.when(F.col("op") == PUT, X.frontmatter(F.col("content")))).drop("content")
    valid = (F.col("op") == DELETE) | (F.col("f.name") == F.col("name"))
    return current(matter, "name", "seq", F.coalesce(valid, F.lit(False))).select("name", "seq", "f.description", "f.body")


# What stands before and after the list of what is known.
CATALOGUE_HEAD = "У тебя есть база знаний. Каталог:\n\n"
CATALOGUE_TAIL = (
    "\nЕсли знание кажется релевантным текущей задаче, вызови knowledge_load(name). "
    "Загруженное знание попадёт в контекст и будет доступно в следующих ходах. Чтобы снять знание, вызови knowledge_unload()."
)


def catalogue_prompts(entries: DataFrame, by: list[str], most: int = 200) -> DataFrame:
    """(by, part, prompt): the entries (name, description) of each owner by name, as text to show, in parts of ``most`` entries; no row without entries."""
    line = F.concat(F.lit("- "), "name", F.lit(" — "), "description", F.lit("\n"))
    listed = parts(entries, by, ["name"], line, most)
    return listed.select(*by, "part", F.concat(F.lit(CATALOGUE_HEAD), F.array_join("items", ""), F.lit(CATALOGUE_TAIL)).alias("prompt"))
