"""A folder of text files, one record each, as a Spark data source: read in partitions, written by name with a commit.

``spark.dataSource.register(Records)``; then ``spark.read.format("records").load(path)`` gives (name, size, content), and
``df.write.format("records").mode("append").save(path)`` puts each (name, content) in the file of that name, in place
of an older one; mode overwrite also removes all others. Tasks write into a folder of the job; only when all of them have ended are
the files moved to their names, each in one step. A write that is aborted removes its folder and leaves every old
file as it was; a retried or speculative task leaves nothing, as only what a task reported is moved.

Filters on name (equal, in, starts with) are pushed down when ``spark.sql.python.filterPushdown.enabled`` is set: other
files aren't opened. Files go to partitions of about ``PARTITION`` bytes; names that start with a point are never read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

PARTITION = 32 << 20
SCHEMA = "name string, size bigint, content string"
NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*\Z")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted, self.starts = path, None, ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes filters on name; others are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.starts = (*self.starts, f.value)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted((i.base_name, i.size) for i in found if i.is_file and not i.base_name.startswith("."))
        names = [n for n in names if (self.wanted is None or n[0] in self.wanted) and all(n[0].startswith(s) for s in self.starts)]
        out, size = [], PARTITION
        for name in names:
            if size >= PARTITION:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += name[1] + 4096
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _open(self.path)
        for name, size in partition.names:
            with store.open_input_stream(f"{root}/{name}") as source:
                content = source.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([content])], names=["name", "size", "content"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # the job's file, the record's name


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f".job-{uuid.uuid4().hex}"
        store, root = _open(path)
        store.create_dir(f"{root}/{self.job}", recursive=True)  # here alone: a task that outlives an abort finds no folder

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _open(self.path)
        done = []
        for row in iterator:
            if row.name is None or not NAME.match(row.name):
                raise ValueError(f"no name of a record: {row.name!r}")
            draft = uuid.uuid4().hex
            with store.open_output_stream(f"{root}/{self.job}/{draft}") as out:
                out.write((row.content or "").encode())
            done.append((draft, row.name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        done = [pair for m in messages if m for pair in m.names]
        names = [name for _, name in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a name is written twice")
        for draft, name in done:
            store.move(f"{root}/{self.job}/{draft}", f"{root}/{name}")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.is_file and not info.base_name.startswith(".") and info.base_name not in set(names):
                    store.delete_file(info.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")
