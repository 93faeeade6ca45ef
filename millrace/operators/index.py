"""The stored index of all corpora: files become chunks with vectors, kept in buckets under versions.

A file belongs to one of a fixed number of buckets by a hash of its corpus and path. A change writes the buckets of
the files that it touches into a folder of its own and leaves all others where they are. A version is a small
manifest (bucket -> folder), published by creating its number's file last, which fails if another writer was
first. So readers see a version whole or not at all, and what a lost writer left is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.chunking import chunk_rows
from millrace.operators.vectors import encode

KEY = ("corpus", "path", "mtime", "size")
BUCKETS = 64
FEW = 100_000  # changed files whose keys are broadcast: the index isn't shuffled to take them out
SMALL = 1 << 20  # bytes of a bucket's files on average, below which a rewrite puts them together
SCHEMA = (
    "corpus string, path string, mtime bigint, size bigint, idx int, chunk string, start_byte bigint, end_byte bigint, embedding array<double>"
)


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """Counts of words by hash: an encoder that needs no model."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            row[zlib.crc32(word.encode()) % size] += 1
    return out


def together(corpora: dict[str, DataFrame]) -> DataFrame:
    """(corpus, path, mtime, size, text): the files of all corpora in one table; those without bytes are left out."""
    rows = [files.select(F.lit(name).alias("corpus"), "path", "mtime", "size", "text") for name, files in corpora.items()]
    return reduce(DataFrame.unionByName, rows).where("size > 0")


def bucket_of(corpus: Column, path: Column, buckets: Column | int) -> Column:
    digits = F.substring(F.md5(F.concat_ws("/", corpus, path)), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % buckets).cast("int")


def chunked(files: DataFrame, encoder=hashed_words, size: int = 512, overlap: int = 64) -> DataFrame:
    """Rows of the index of ``files``. Nothing is shuffled: texts are cut and encoded where they are."""
    rows = encode(chunk_rows(files.select(*KEY, "text"), size, overlap), encoder, "chunk")
    return rows.select(*(F.col(n).cast(t) for n, t in (c.split() for c in SCHEMA.split(", "))))


class Store:
    """An index below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, encoder=hashed_words, size: int = 512, overlap: int = 64) -> None:
        """buckets: of a new store; one that is there keeps its own."""
        self.spark, self.root, self.encoder, self.size, self.overlap = spark, root.rstrip("/"), encoder, size, overlap
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._new = buckets

    def _manifest(self) -> dict:
        """The newest published version."""
        folder = self._path(f"{self.root}/versions")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []
        if not names:
            return {"version": 0, "buckets": self._new, "folders": {}, "batches": {}}
        read = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{names[-1]}").first()[0]
        return json.loads(read)

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def _publish(self, manifest: dict) -> None:
        """Makes a version visible: its file is written under another name and renamed, which fails where the number is taken (as on HDFS)."""
        name, draft = f"{self.root}/versions/{manifest['version']:010d}", f"{self.root}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(json.dumps(manifest).encode())
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(draft), self._path(name)):
            raise RuntimeError(f"version {manifest['version']} was published by another writer")

    def _read(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        """Rows of some buckets (all by default), in one scan; the schema is that of writing, so an empty store can be read too."""
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, f in sorted(manifest["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """All chunks of the newest version."""
        return self._read(self._manifest())

    def valid(self, disk: DataFrame) -> DataFrame:
        """Chunks whose file is on disk as it was when they were written."""
        return self.rows().join(disk.select(*KEY), list(KEY), "left_semi")

    def written(self) -> DataFrame:
        """(bucket, version): the version that wrote each bucket that has rows."""
        rows = [(int(b), int(f.split("-")[0])) for b, f in self._manifest()["folders"].items()]
        return self.spark.createDataFrame(rows, "bucket int, version bigint")

    def differences(self, disk: DataFrame) -> DataFrame:
        """(corpus, path, was, is): files to take out (was) and to put in (is), by time and size; unchanged ones are left out."""
        return self._differences(disk, self._manifest())

    def _differences(self, disk: DataFrame, manifest: dict) -> DataFrame:
        had = self._read(manifest).where("idx = 0").select("corpus", "path", F.struct("mtime", "size").alias("had"))
        has = disk.select("corpus", "path", F.struct("mtime", "size").alias("has"))
        both = had.join(has, ["corpus", "path"], "full_outer")
        changed = ~F.col("had").eqNullSafe(F.col("has"))
        return both.where(changed).select("corpus", "path", F.col("had").isNotNull().alias("was"), F.col("has").isNotNull().alias("is"))

    def sync(self, disk: DataFrame) -> int:
        """Brings the index to what is on disk (corpus, path, mtime, size, text); the version after it. Texts of unchanged files aren't cut."""
        manifest = self._manifest()
        found = self._differences(disk.select(*KEY), manifest)
        keys = found.select("corpus", "path", "is").persist()
        try:
            if manifest["folders"]:
                disk = disk.join(self._few(keys).where("is").select("corpus", "path"), ["corpus", "path"], "left_semi")
            return self._apply(manifest, keys.select("corpus", "path"), disk, {})
        finally:
            keys.unpersist()

    def apply(self, changes: DataFrame, stream: str = "", batch: int = -1) -> int:
        """Takes in changed files: (corpus, path, mtime, size, text), a null size for one that is gone; one row a file.

        A batch of a stream that is in already, by its number, changes nothing.
        """
        manifest = self._manifest()
        if stream and manifest["batches"].get(stream, -1) >= batch:
            return manifest["version"]
        keys = changes.select("corpus", "path")
        return self._apply(manifest, keys, changes.where("size > 0"), {stream: batch} if stream else {})

    def replace(self, files: DataFrame) -> int:
        """A version of these files alone."""
        manifest = self._manifest()
        return self._write(manifest, files, set(manifest["folders"]), {})

    def _few(self, keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys

    def _apply(self, manifest: dict, keys: DataFrame, new: DataFrame, batch: dict) -> int:
        bucket = bucket_of(F.col("corpus"), F.col("path"), manifest["buckets"])
        touched = {str(r[0]) for r in keys.select(bucket).distinct().collect()}  # as many as there are buckets at most
        if not touched and not batch:
            return manifest["version"]
        return self._write(manifest, new, touched, batch, keys)

    def _kept(self, manifest: dict, touched: set[str], keys: DataFrame) -> DataFrame | None:
        """Rows of touched buckets that stay. Their files are read as they lie, one bucket each, and so written; they are dealt anew only if the join deals them or many are small."""
        old = {b: f for b, f in manifest["folders"].items() if b in touched}
        if not old:
            return None
        gone = self._few(keys)
        kept = self._read(manifest, touched).join(gone, ["corpus", "path"], "left_anti")
        sizes = [self._fs.getContentSummary(self._path(f"{self.root}/data/{f}/bucket={b}")) for b, f in old.items()]
        files = sum(s.getFileCount() for s in sizes)
        dealt = gone is keys or (files > 4 * len(old) and sum(s.getLength() for s in sizes) < SMALL * files)
        return self._dealt(kept, manifest) if dealt else kept

    def _dealt(self, rows: DataFrame, manifest: dict) -> DataFrame:
        bucket = bucket_of(F.col("corpus"), F.col("path"), manifest["buckets"])
        return rows.withColumn("bucket", bucket).hint("rebalance", "bucket").drop("bucket")

    def _write(self, manifest: dict, new: DataFrame, touched: set[str], batch: dict, keys: DataFrame | None = None) -> int:
        """Writes touched buckets, then publishes. New files are dealt to buckets as texts, before chunks and vectors are made of them; no keys: nothing is kept."""
        version = manifest["version"] + 1
        folder = f"{version:010d}-{uuid.uuid4().hex}"
        rows = chunked(self._dealt(new.select(*KEY, "text"), manifest), self.encoder, self.size, self.overlap)
        kept = self._kept(manifest, touched, keys) if keys is not None else None
        rows = (rows if kept is None else kept.unionByName(rows)).withColumn("bucket", bucket_of(F.col("corpus"), F.col("path"), manifest["buckets"]))
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data/{folder}"))]
        folders = {b: f for b, f in manifest["folders"].items() if b not in touched}
        folders |= {n.removeprefix("bucket="): folder for n in names if n.startswith("bucket=")}
        self._publish({"version": version, "buckets": manifest["buckets"], "folders": folders, "batches": manifest["batches"] | batch})
        return version

    def vacuum(self) -> list[str]:
        """Deletes data that the newest version doesn't name, whole folders and buckets of others: run it when no older version is read and nothing is written."""
        live = {(f, f"bucket={b}") for b, f in self._manifest()["folders"].items()}
        data = self._path(f"{self.root}/data")
        gone = []
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            if name not in {f for f, _ in live}:
                gone.append((name, folder.getPath()))
            else:
                parts = [s.getPath() for s in self._fs.listStatus(folder.getPath())]
                gone += [(f"{name}/{p.getName()}", p) for p in parts if p.getName().startswith("bucket=") and (name, p.getName()) not in live]
        for _, path in gone:
            self._fs.delete(path, True)
        return sorted(name for name, _ in gone)


def build(files: DataFrame, path: str, encoder=hashed_words, size: int = 512, overlap: int = 64) -> None:
    """Writes the index of ``files`` anew. Files that aren't UTF-8 have a null text and no rows."""
    Store(files.sparkSession, path, BUCKETS, encoder, size, overlap).replace(files)


def load(spark: SparkSession, path: str, disk: DataFrame) -> DataFrame:
    """Entries whose file is on disk as it was when they were written."""
    return Store(spark, path).valid(disk)
