"""Sessions as a log of saves, and notes on directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "***"
NOTES = ("about", "summary")


def saved(saves: DataFrame, seq: str) -> DataFrame:
    """The stored form of each session (owner_agent, session_id, deleted, context, ...) after all of its saves.

    The save with the largest ``seq`` counts, but a session that was once deleted stays so. Keys in
    ``context.engine_config.api_key`` are masked before anything is shuffled; a session without a context keeps none.
    A null owner is an owner of its own; a null session_id has no file and is left out.
    """
    by = ["owner_agent", "session_id"]
    rest = [c for c in saves.columns if c not in (*by, "deleted")]
    rows = saves.where(F.col("session_id").isNotNull()).withColumn("context", F.col("context").withField("engine_config.api_key", F.lit(MASK)))
    deleted = F.bool_or(F.coalesce("deleted", F.lit(False))).alias("deleted")
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x"), deleted).select(*by, "deleted", "x.*")


def directory_notes(writes: DataFrame, seq: str) -> DataFrame:
    """(project_id, dir, about, summary) after a log of writes (project_id, dir, kind, content, seq); null where none was written.

    The last write of a kind counts, an empty content too. Other kinds are not read.
    """
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("content")), F.when(F.col("kind") == k, F.col(seq))).alias(k)
    return writes.where(F.col("kind").isin(*NOTES)).groupBy("project_id", "dir").agg(*map(last, NOTES))
