"""Cosine search of a set of query vectors against all vectors, and rankings of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_024  # queries that one task holds against a part of the vectors
PART = 16_384  # vectors in a part
STEP = 128  # queries whose distances to a part are held at once: 16 MB
TASKS = 8  # at least so many parts where there is no key


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def knn(vectors: DataFrame, queries: DataFrame, k: int, keep_self: bool = False, by: str | None = None) -> DataFrame:
    """(by, query_id, vec_id, dist, rank): the k vectors of least cosine distance for each query, among those with its key ``by``.

    ``vectors`` and ``queries`` have vec_id and embedding (equally long, not null, not zero), and the key if one is
    named; a null key matches none. A tile is a block of a key's queries against a part of its vectors, so the sizes of
    tiles don't depend on how many keys there are nor on how large one is. A task returns each query's k nearest of
    its tile, a window keeps the k of all. Distances are compared after rounding to 6 digits, ties go to the smaller vec_id.
    """
    key = F.col(by) if by else F.lit(0)
    right = vectors.select("vec_id", "embedding", key.alias("key")).where(F.col("key").isNotNull())
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), key.alias("key")).where(F.col("key").isNotNull())
    held, asked = (x.groupBy("key").agg(F.count(F.lit(1)).alias(n)) for x, n in ((right, "n"), (left, "q")))
    tiles = held.join(asked, "key")
    share = F.lit(1 if by else TASKS)
    tiles = tiles.select("key", F.greatest(F.ceil(F.col("n") / PART), share).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = right.join(tiles, "key").select("key", "vec_id", "embedding", part, every("blocks").alias("block"))
    left = left.join(tiles, "key").select("key", "query_id", "asked", block, every("parts").alias("part"))

    def match(names: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            ids, own = held.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
            a, b = _unit(_matrix(asked.column("asked"))), _unit(_matrix(held.column("embedding")))
            for at in range(0, len(own), STEP):
                dist = np.round(1.0 - a[at : at + STEP] @ b.T, 6)
                if not keep_self:
                    dist[own[at : at + STEP, None] == ids] = np.inf
                last = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) else np.full((len(dist), 1), np.inf)
                row, column = np.nonzero((dist <= last) & np.isfinite(dist))
                order = np.lexsort((ids[column], dist[row, column], row))
                row, column = row[order], column[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, column = row[nth < k], column[nth < k]
                out.append((own[at + row], ids[column], dist[row, column]))
        flat = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        found = {"query_id": pa.array(flat[0], pa.int64()), "vec_id": pa.array(flat[1], pa.int64()), "dist": pa.array(flat[2], pa.float64())}
        return pa.table({"key": pa.array([names[0].as_py()] * len(flat[0]), names[0].type)} | found)

    tile = ["key", "block", "part"]
    kind = dict(right.dtypes)["key"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(match, f"key {kind}, query_id bigint, vec_id bigint, dist double")
    order = Window.partitionBy("key", "query_id").orderBy("dist", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.withColumnRenamed("key", by) if by else found.drop("key")


def encode(texts: DataFrame, encoder, text: str = "text") -> DataFrame:
    """Adds ``embedding`` by a function from a list of texts to a matrix; rows get unit length. The model is the caller's."""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(encoder([t or "" for t in batch.column(names.index(text)).to_pylist()]), np.float64)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*names, "embedding"])

    from pyspark.sql import types as T

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def within(hits: DataFrame, most: float) -> DataFrame:
    """Hits of at most this distance; a missing distance counts as 1."""
    return hits.where(F.coalesce("dist", F.lit(1.0)) <= most)


def aggregate_hits(hits: DataFrame, *by: str, phrase: str = "phrase") -> DataFrame:
    """Distinct phrases and least distance of each group."""
    return hits.groupBy(*by).agg(F.countDistinct(phrase).alias("hits"), F.min("dist").alias("min_dist"))


def tool_score(hits: Column, dist: Column) -> Column:
    """(1 - d) * h / (h + 1/2), 0 without hits."""
    return F.when(hits == 0, 0.0).otherwise((1 - dist) * hits / (hits + 0.5))


def pool(candidates: DataFrame, slots: DataFrame, allowed: DataFrame, *by: str) -> DataFrame:
    """Candidates and slots of the allowed names, once each; a slot keeps its candidate's score, else 0."""
    return candidates.join(slots, [*by, "name"], "full").join(allowed, "name", "left_semi").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def success_rate(success: Column, fail: Column) -> Column:
    return success / (success + fail + 1)
