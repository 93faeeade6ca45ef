"""The stored index kept up to date by a stream of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.index import Store


def latest(events: DataFrame) -> DataFrame:
    """(corpus, path, mtime, size, text): the last event of each file by ``at``, a removal before a write of the same moment; its size is null."""
    gone = F.col("op") == "remove"
    row = F.struct("mtime", F.when(~gone, F.col("size")).alias("size"), F.when(~gone, F.col("text")).alias("text"))
    last = events.groupBy("corpus", "path").agg(F.max_by(row, F.struct("at", ~gone, "mtime")).alias("r"))
    return last.select("corpus", "path", "r.*")


def maintain(events: DataFrame, root: str, checkpoint: str, name: str = "files", **trigger) -> StreamingQuery:
    """Applies (corpus, path, op write or remove, at, mtime, size, text) to the index below ``root``, a version for each batch.

    A batch that is run again, as after a failure between its version and the stream's own commit, changes nothing:
    the version holds the number of the last batch under ``name``. Files that came in order stay in order, as a later batch wins.
    """

    def step(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, root).apply(latest(batch), name, number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
