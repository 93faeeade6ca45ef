"""Pieces that the operators share: reading tables, scratch tables, folds, bounded samples, vector sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 65_536  # elements of a summed vector that are sent at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode, as in tests, a local one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch("local(\\[.*\\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared checkpoint folder: they cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/millrace-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where the fold is the held-out one; a null id is never held out."""
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def bounded_sample(keys: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``keys`` at most, the same on every run: a hash of the key decides."""
    n = keys.count()
    if n <= rows:
        return keys
    space = 1 << 30
    return keys.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(space)) < int(space * rows / n))


def labelled(labels: DataFrame, column: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from; of several labels of one document the largest."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg(F.max(F.col(column)).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1))
    )


def balanced_sample(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most about rows/2 of either label; a class with less is taken whole."""
    halves = [bounded_sample(labels.where(F.col("y") == y), "doc_id", rows // 2, seed) for y in (0, 1)]
    return halves[0].unionByName(halves[1])


def weighted_sample(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, y, weight): at most about ``rows`` rows and a twelfth more, a label with few rows not thinned below a twelfth of them.

    weight is 1 for the label that is thinned least, else by how much more its rows stand for; where labels are thinned
    alike, all weigh 1.
    """
    counts = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}  # two rows at most
    n = sum(counts.values())
    rates = {y: min(1.0, max(rows / n, rows / 12 / c)) for y, c in counts.items()}
    top = max(rates.values(), default=1.0)
    space = 1 << 30
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(space))
    rate = reduce(lambda a, y: a.when(F.col("y") == y, F.lit(rates[y])), rates, F.when(F.lit(False), F.lit(0.0)))
    return labels.select("doc_id", "y", (F.lit(top) / rate).alias("weight"), rate.alias("__rate"), pick.alias("__pick")).where(F.col("__pick") < F.floor(F.col("__rate") * space)).drop("__rate", "__pick")


def text_slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters, one row at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "") + 2
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    score: Callable[[list[str | None]], list],
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) and those that ``score`` computes from a list of texts.

    A column that ``df`` already has under a new one's name is replaced.
    """
    new = {f.name for f in fields}
    names = [c for c in (keep or df.columns) if c not in new]
    source = df.select(*names, F.col(text_col).alias("__text"))
    schema = T.StructType([df.schema[c] for c in names] + fields)
    kinds = [_ARROW[f.dataType.simpleString()] for f in fields]
    rows = 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(len(names)).to_pylist()
                columns = [pa.array(c, type=k) for c, k in zip(score(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + columns, names=[*names, *(f.name for f in fields)]
                )

    return source.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def summed_vectors(df: DataFrame, columns: list[str], count: Callable, length: int) -> dict[str, np.ndarray]:
    """Sums of float64 vectors by key. ``count`` maps an iterator of record batches to {key: vector}.

    Each task sums its own rows; a row for each element that isn't 0 goes to Spark's aggregation, so no group holds
    what grows with the number of tasks. The driver receives the sums alone: the caller bounds keys and length.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, vector in count(batches).items():
            at = np.flatnonzero(vector)
            for a in range(0, len(at), SEGMENT):
                some = at[a : a + SEGMENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(vector[some], pa.float64())], names=["key", "at", "value"]
                )

    sums = df.select(*columns).mapInArrow(local, "key string, at int, value double").groupBy("key", "at").agg(F.sum("value").alias("value")).toArrow()
    keys, at, values = sums.column("key").combine_chunks().dictionary_encode(), sums.column("at").to_numpy(), sums.column("value").to_numpy()
    out: dict[str, np.ndarray] = {}
    if len(at):
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        of = keys.indices.to_numpy()
        for i, key in enumerate(keys.dictionary.to_pylist()):
            out[key] = np.zeros(length)
            out[key][at[of == i]] = values[of == i]
    return out
