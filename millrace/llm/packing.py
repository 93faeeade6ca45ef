"""Mixture-controlled packing: deficit round-robin over source queues.

Every sequence takes tokens from all queues in target proportions; what a queue is owed or has taken too early is
carried to the next sequence. Serving the queue that is furthest behind, token by token, gives each queue s after
w sequences C_s(w) tokens, where its k-th token is due at time (k + 1/2) / rate_s; that has a closed form (find the
time at which w * length tokens are due), so any task knows the deficits at any sequence without the ones before,
and they carry across partitions. Queues that run dry leave their share to the others.

Documents are tokenised once, into a table of blocks. The queue order is the order of tasks, of blocks in them and
of rows in those; each block knows what its task has put into each queue before it. A prefix sum of one number per
task and source says where a task's documents begin in their queues, and each block then cuts its own documents: no
text or token id is ever shuffled.

Any number of sources are queues of their own. The driver and the tasks hold two numbers and the name of each
source (not of documents), and work on ``CELLS`` numbers of sequences and queues at a time.

Defined cases: null and empty texts have the closing id alone; a null source is a queue of its own; a source without
a target comes after all others; repeated rows are packed each; an empty table gives no sequence; a null doc_id
stays null; other columns are not read. A very long text is tokenised in parts, cut where the vocabulary's pattern
always cuts; its ids (2 bytes each) are in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

LENGTH = 2048
CLOSING = 1  # id at the end of each document
BLOCK_CHARS = 1 << 20
PART_CHARS = 1 << 19  # longer texts are tokenised in parts
CELLS = 1 << 20
TASKS = 4096  # tasks whose places are summed together
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_BETWEEN = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")  # the pattern always cuts before such a space
_ENCODERS: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The byte-level BPE of a tokenizer file with its added tokens, one for each worker.

    Ids are those of the file read by ``tokenizers``. They come from the ranks of the same vocabulary, which lie
    beside it, through another library that is three times as fast; strings of added tokens get their own ids.
    """
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that change what lies around them")
        with open(re.sub("\\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text of about ``limit`` characters whose tokens are those of the whole; a text without a place to cut is one."""
    at = 0
    while len(text) - at > limit:
        found = _BETWEEN.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_ids(encode, text: str | None) -> np.ndarray:
    """Ids of a text and the closing one, in as many bytes as the vocabulary's largest id takes."""
    kind = np.uint16 if encode.max_token_value < 1 << 16 else np.uint32
    found = [encode.encode_to_numpy(p, allowed_special="all").astype(kind) for p in parts(text)] if text else []
    return np.concatenate([*found, np.array([CLOSING], kind)])


def _queue_name(source: str | None) -> str:
    return "" if source is None else f"={source}"


def tokenise(documents: DataFrame, path: str | None) -> DataFrame:
    """(task, sources, counts, before, doc_ids, names, sizes, ids): a block's token counts by source, those of its task's earlier blocks, and its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path())
        task = TaskContext.get().partitionId()
        given: dict[str, int] = {}
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths.tolist()):
                part = batch.slice(a, b - a)
                ids = [token_ids(encode, t.as_py()) for t in part.column(2)]
                names = [_queue_name(s) for s in part.column(1).to_pylist()]
                sizes = [len(i) for i in ids]
                totals: dict[str, int] = {}
                for name, n in zip(names, sizes, strict=True):
                    totals[name] = totals.get(name, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task], pa.int64()),
                        pa.array([list(totals)], pa.list_(pa.string())),
                        pa.array([list(totals.values())], pa.list_(pa.int64())),
                        pa.array([[given.get(name, 0) for name in totals]], pa.list_(pa.int64())),
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([names], pa.list_(pa.string())),
                        pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                    ],
                    names=["task", "sources", "counts", "before", "doc_ids", "names", "sizes", "ids"],
                )
                for name, n in totals.items():
                    given[name] = given.get(name, 0) + n

    schema = "task bigint, sources array<string>, counts array<bigint>, before array<bigint>, doc_ids array<bigint>, names array<string>, sizes array<bigint>, ids binary"
    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").mapInArrow(run, schema)


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``BLOCK_CHARS`` characters, one document at least."""
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += n + 2
    if begin < len(lengths):
        yield begin, len(lengths)


class Schedule:
    """What each queue has given after any number of sequences."""

    def __init__(self, sizes: np.ndarray, rates: np.ndarray, length: int = LENGTH) -> None:
        self.sizes, self.length = sizes.astype(np.int64), length
        most = float(rates.max()) if len(rates) and rates.max() > 0 else 1.0
        self.rates = np.where(sizes > 0, np.maximum(rates / most, 1e-9), 0.0)
        live = self.rates > 0
        self.end = 1.0 + float((self.sizes[live] / self.rates[live]).max()) if live.any() else 1.0
        self.total = int(self.sizes.sum())
        self.rows = max(1, CELLS // max(len(sizes), 1))  # sequences that are handled at once

    def due(self, time: np.ndarray) -> np.ndarray:
        """times x queues: tokens that are due."""
        return np.minimum(np.floor(time[:, None] * self.rates + 0.5).astype(np.int64), self.sizes)

    def given(self, sequences: np.ndarray) -> np.ndarray:
        """sequences x queues: tokens given before each of these sequences."""
        want = np.minimum(sequences * self.length, self.total)
        low, high = np.zeros(len(want)), np.full(len(want), self.end)
        for _ in range(80):
            middle = 0.5 * (low + high)
            less = self.due(middle).sum(axis=1) <= want
            low, high = np.where(less, middle, low), np.where(less, high, middle)
        base, more = self.due(low), self.due(high)
        lack = want - base.sum(axis=1)
        room = more - base
        before = np.cumsum(room, axis=1) - room
        return base + np.clip(lack[:, None] - before, 0, room)

    def near(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The sequence of a queue's token, give or take one."""
        rank = np.zeros(len(token), np.int64)
        for at in range(0, len(token), self.rows):
            part = slice(at, at + self.rows)
            rank[part] = self.due((token[part] + 0.5) / self.rates[queue[part]]).sum(axis=1)
        return rank // self.length


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def cut(schedule: Schedule, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, sequence, offset) of the pieces of documents at places of their queues."""
    first = np.maximum(schedule.near(queue, begin) - 1, 0)
    n = schedule.near(queue, begin + size - 1) + 2 - first
    doc, sequence = np.repeat(np.arange(len(size)), n), _ranges(first, n)
    order = np.argsort(sequence, kind="stable")
    doc, sequence = doc[order], sequence[order]
    q = queue[doc]
    known = np.unique(np.concatenate([sequence, sequence + 1]))
    # before and after each sequence: tokens of the piece's queue, and of the queues ahead of it
    own, ahead = np.zeros((2, len(sequence)), np.int64), np.zeros((2, len(sequence)), np.int64)
    for at in range(0, len(known), schedule.rows):
        some = known[at : at + schedule.rows]
        given = schedule.given(some)
        sums = np.cumsum(given, axis=1) - given
        for k in (0, 1):
            here = slice(*np.searchsorted(sequence, (some[0] - k, some[-1] - k + 1)))
            place = np.searchsorted(some, sequence[here] + k)
            own[k, here], ahead[k, here] = given[place, q[here]], sums[place, q[here]]
    lo, hi = np.maximum(own[0], begin[doc]), np.minimum(own[1], (begin + size)[doc])
    offset = ahead[1] - ahead[0] + lo - own[0]
    some = lo < hi
    doc, lo, hi = doc[some], lo[some], hi[some]
    return doc, lo - begin[doc], hi - lo, sequence[some], offset[some]


def _places(blocks: DataFrame) -> DataFrame:
    """(of_task, places): tokens of the earlier tasks in each queue. One number per task and source, summed in groups of tasks."""
    pairs = blocks.select("task", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("task", F.col("x.sources").alias("name"))
    counts = pairs.agg(F.sum("x.counts").alias("n")).withColumn("range", F.floor(F.col("task") / TASKS))
    earlier = lambda *by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("name", "range").agg(F.sum("n").alias("n")).select("name", "range", earlier("name", order="range").alias("base"))
    inside = counts.select("task", "name", "range", earlier("name", "range", order="task").alias("before")).join(ranges, ["name", "range"])
    return inside.groupBy(F.col("task").alias("of_task")).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("before") + F.col("base")))).alias("places"))


def pack(documents: DataFrame, targets: dict[str | None, float] | None = None, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens. ``targets``: rates by source; by default each source's share of all tokens."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.save(tokenise(documents, path), "blocks")
    sums = blocks.select(F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy(F.col("x.sources").alias("name")).agg(F.sum("x.counts").alias("n"))
    sums = sorted((r["name"], r["n"]) for r in sums.collect())  # a row for each source
    names, sizes = [name for name, _ in sums], np.array([n for _, n in sums], np.int64)
    index = {name: i for i, name in enumerate(names)}
    rates = sizes.astype(float) if targets is None else np.array([targets.get(None if name == "" else name[1:], 0.0) for name in names], float)
    shared = spark.sparkContext.broadcast((Schedule(sizes, rates, length), index))
    places = scratch.save(_places(blocks), "places")  # a table: its size decides whether it is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, index = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                doc_ids, of, sizes, sources, before = (row[c].as_py() for c in ("doc_ids", "names", "sizes", "sources", "before"))
                base = dict(row["places"].as_py())
                at = {index[s]: base[s] + b for s, b in zip(sources, before, strict=True)}
                q, size = np.array([index[n] for n in of], np.int64), np.array(sizes, np.int64)
                begin = np.empty(len(q), np.int64)
                for k, from_ in at.items():
                    mine = np.flatnonzero(q == k)
                    begin[mine] = from_ + np.cumsum(size[mine]) - size[mine]
                doc, start, n, sequence, offset = cut(schedule, q, begin, size)
                packed = row["ids"].as_buffer()
                kind = np.uint16 if packed.size == 2 * size.sum() else np.uint32
                data = memoryview(np.frombuffer(packed, kind).astype("<u4")).cast("B")
                first = (np.cumsum(size) - size)[doc] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
                        *(pa.array(x, pa.int64()) for x in (start, n, crc, size[doc], sequence, offset)),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return blocks.drop("counts").join(places, F.col("task") == F.col("of_task")).drop("task", "of_task").mapInArrow(run, SCHEMA)
