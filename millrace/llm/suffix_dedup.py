"""Removal of repeated 50-byte strings by a depth-limited radix sort of suffixes.

Only the first ``DEPTH`` bytes of a suffix matter, so suffixes are never sorted beyond them. They are ordered by
digits, most significant first, and what is alone in its group after a digit is finished:

1. Suffixes are gathered into runs: neighbouring ones whose first ``DEPTH`` bytes have the same smallest 16-byte
   hash (and lie on the same side of it) share 33 bytes around it, the run's first digit. Equal strings choose
   equal places, so equal suffixes always fall into runs with equal digits.
2. First pass: digits that only one document has are dropped; a bit per digit goes back.
3. Second pass: what is left of a run, all its bytes, is the second digit. Where one second digit follows a first
   one, the whole run is repeated and its smallest doc_id is known.
4. Third pass: where several follow (the ends of repeats), every suffix of such a run gets its own digit of
   ``DEPTH`` bytes, and the groups are exactly the repeated strings.

Documents stand in blocks, and blocks in units: a third of what a shuffle partition would hold of the input, in the
bounds ``UNIT_BYTES``. Each unit removes its own doubles before
anything is shuffled, so a passage that every document holds is one entry per unit. Digits travel as arrays, a row
for each unit and bucket, as in Spark's own shuffles a block for each map task and partition; buckets are cut by hash.
Units stay in a table bucketed by unit: the answers come to them, and texts are not shuffled again. A text is never
cut, so one of many times ``BLOCK_BYTES`` needs some 60 times its bytes in one worker.

Hashes: the first digit's only decides what is looked at; second and third digits are compared by 64 bits within
groups of equal first digits (96 bits and more together).

Defined cases: null text is empty; texts under 50 bytes lose nothing; a null doc_id counts as larger than all
others; rows with the same doc_id do not remove anything from each other; empty tables give empty results;
other columns are carried along on request.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, shuffle_partitions

DEPTH = 50
GRAM = 16
WINDOW = DEPTH - GRAM + 1  # grams in a string
HALF = WINDOW // 2
BLOCK_BYTES = 2 << 20
UNIT_BYTES = (2 << 20, 32 << 20)
BUCKET_BYTES = 24 << 20  # input bytes for each bucket of digits
SPREAD = 2  # buckets for each shuffle partition at least, so that hashing spreads them evenly
CHUNK = 1 << 18  # suffixes whose hashes are held at once
NO_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


class Block:
    """The documents of a block as one byte array, with the runs of their suffixes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        text = batch.column(batch.num_columns - 1)
        ids = batch.column(0)
        self.ids = np.array(pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False), np.int64)
        n = len(text)
        raw = [b.as_py() or b"" for b in text.cast(pa.binary())]
        self.lengths = np.fromiter((len(b) for b in raw), np.int64, n)
        self.data = np.frombuffer(b"".join(raw) + bytes(96), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        found = [self._runs(a, b) for a, b in self._ranges()]
        self.first, self.count, self.place, self.side = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)
        )
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _ranges(self) -> Iterator[tuple[int, int]]:
        total = int(self.ends[-1]) if len(self.ends) else 0
        for a in range(0, total, CHUNK):
            yield a, min(a + CHUNK, total)

    def _runs(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Runs of the suffixes that start in [a, b): first suffix, number of suffixes, place and side of the smallest gram."""
        m = b - a + WINDOW - 1
        w = self.words[a : a + m + 8]
        m = min(m, len(w) - 8)
        h = _mix(w[:m] * _A + w[8 : m + 8] * _B)
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= np.arange(m, dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, WINDOW - 32):
            h = np.minimum(h[:-step], h[step:])
        place = (h[: b - a] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        whole = np.zeros(b - a + 1, np.int64)
        lo, hi = np.clip(self.starts - a, 0, b - a), np.clip(self.ends - DEPTH + 1 - a, 0, b - a)
        some = lo < hi
        np.add.at(whole, lo[some], 1)
        np.add.at(whole, hi[some], -1)
        at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
        at = at[at < len(place)]
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        place = place[at]
        side = (place - at) >= HALF
        key = place * 2 + side
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]))
        return at[begin] + a, np.diff(np.append(begin, len(at))), place[begin] + a, side[begin].astype(np.int64)

    def hash(self, start: np.ndarray, length: np.ndarray | int, loads: int) -> np.ndarray:
        """Hash of ``length`` bytes (8 at least, 8 * loads at most) from each start."""
        last = np.asarray(length) - 8
        h = np.zeros(len(start), np.uint64)
        for j in range(loads):
            h = _mix(h * _A + self.words[start + np.minimum(8 * j, last)] + np.uint64(j + 1))
        return h

    def first_digits(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct digits as bucket << 32 | hash, whether several documents have it, order of the runs, its group bounds)."""
        h = self.hash(self.place - HALF * self.side, GRAM + HALF, 5)
        key = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bounds = np.append(begin, len(key))
        ids = self.ids[self.doc[order]]
        several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(key) else np.zeros(0, bool)
        return key[begin], several, order, bounds


class Survivors:
    """What is left of a block's runs after the first pass: entries are distinct (first, second) digits."""

    def __init__(self, block: Block, buckets: int, alive: np.ndarray) -> None:
        digits, _, order, bounds = block.first_digits(buckets)
        keep = _place(alive, digits) >= 0
        runs = np.repeat(keep, np.diff(bounds))
        self.run = order[runs]
        digit = np.repeat(digits, np.diff(bounds))[runs]
        size = DEPTH - 1 + block.count[self.run]
        second = block.hash(block.first[self.run], size, 9) ^ (size * 2 + block.side[self.run]).astype(np.uint64)
        ids = block.ids[block.doc[self.run]]
        order = np.lexsort((ids, second, digit))
        self.run, digit, second, ids = self.run[order], digit[order], second[order], ids[order]
        new = np.ones(len(digit), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1  # of each surviving run
        self.digit, self.second, self.least = digit[begin], second[begin], ids[begin]
        self.sample = self.run[begin]


def _place(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _pack(batches: Iterator[pa.RecordBatch], unit_bytes: int) -> Iterator[pa.RecordBatch]:
    unit, block, filled = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(int(np.searchsorted(size, before + BLOCK_BYTES, side="right")), at + 1)
            n = int(size[to - 1] - before)
            if filled and filled + n > unit_bytes:
                unit, block, filled = unit + 1, 0, 0
            sink = pa.BufferOutputStream()
            part = batch.slice(at, to - at)
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit], pa.int64()), pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["unit", "block", "payload"],
            )
            block, filled, at = block + 1, filled + n, to


def _blocks(unit: pa.Table) -> Iterator[Block]:
    """The blocks of a unit in order, one at a time."""
    unit = unit.sort_by("block")
    for payload in unit.column("payload"):
        yield Block(pa.ipc.open_stream(payload.as_buffer()).read_next_batch())


def _by_bucket(unit: int, buckets: np.ndarray, columns: dict[str, np.ndarray], lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}) -> pa.Table:  # noqa: B006
    """A row for each bucket that occurs in the sorted ``buckets``, with the entries' values as bytes. ``lists``: edges and values of several for an entry."""
    present, begin = np.unique(buckets, return_index=True)
    bounds = list(zip(begin.tolist(), np.append(begin, len(buckets))[1:].tolist(), strict=True))
    out = {"bucket": pa.array(present, pa.int64()), "unit": pa.array([unit] * len(present), pa.int64())}
    for name, values in columns.items():
        out[name] = pa.array([values[a:b].tobytes() for a, b in bounds], pa.binary())
    for name, (edge, values) in lists.items():
        out[name] = pa.array([values[edge[a] : edge[b]].tobytes() for a, b in bounds], pa.binary())
    return pa.table(out)


REPLY = "unit bigint, kind int, bucket bigint, x binary, y binary, z binary"
ALIVE, FOUND, WINDOWS = 1, 2, 3  # kinds of replies


def _reply(kind: int, rows: list[tuple]) -> pa.Table:
    """rows: (unit, bucket, up to three arrays)."""
    columns = {"unit": [r[0] for r in rows], "kind": [kind] * len(rows), "bucket": [r[1] for r in rows]}
    values = {c: [r[2 + k].tobytes() if k < len(r) - 2 else None for r in rows] for k, c in enumerate("xyz")}
    return pa.table({c: pa.array(v, t) for (c, v), t in zip({**columns, **values}.items(), (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)})


def _gathered(group: pa.Table) -> tuple[int, list[int], list[list[bytes]]]:
    rows = group.sort_by("unit")
    return rows.column("bucket")[0].as_py(), rows.column("unit").to_pylist(), [rows.column(c).to_pylist() for c in rows.column_names[2:]]


def _first_reduce(group: pa.Table) -> pa.Table:
    """Digits of each unit that several documents have."""
    bucket, units, (digits, several) = _gathered(group)
    arrays = [np.frombuffer(d, np.uint32) for d in digits]
    _, inverse, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    flags = np.concatenate([np.frombuffer(s, bool) for s in several])
    repeated = ((counts > 1) | (np.bincount(inverse, weights=flags, minlength=len(counts)) > 0))[inverse]
    rows, at = [], 0
    for unit, d in zip(units, arrays, strict=True):
        mask = repeated[at : at + len(d)]
        at += len(d)
        if mask.any():
            rows.append((unit, bucket, d[mask]))
    return _reply(ALIVE, rows)


def _second_reduce(group: pa.Table) -> pa.Table:
    """Second digits of each unit that a smaller doc_id has too, or that stand with others under one first digit."""
    bucket, units, (digits, seconds, ids) = _gathered(group)
    arrays = [np.frombuffer(d, np.uint32) for d in digits]
    digit, second = np.concatenate(arrays), np.concatenate([np.frombuffer(s, np.uint64) for s in seconds])
    doc = np.concatenate([np.frombuffer(i, np.int64) for i in ids])
    order = np.lexsort((doc, second, digit))
    d, s = digit[order], second[order]
    new_d = np.ones(len(d), bool)
    new_d[1:] = d[1:] != d[:-1]
    new = new_d.copy()
    new[1:] |= s[1:] != s[:-1]
    least = np.empty(len(d), np.int64)
    least[order] = doc[order][new][np.cumsum(new) - 1]
    of = np.cumsum(new_d) - 1
    mixed = np.empty(len(d), bool)
    mixed[order] = (np.bincount(of, weights=new) > 1)[of]
    told = mixed | (least < doc)
    rows, at = [], 0
    for unit, part in zip(units, arrays, strict=True):
        here = at + np.flatnonzero(told[at : at + len(part)])
        at += len(part)
        if len(here):
            rows.append((unit, bucket, second[here], least[here], mixed[here]))
    return _reply(FOUND, rows)


def _third_reduce(group: pa.Table) -> pa.Table:
    """For each suffix of the runs that a unit asks about, the smallest doc_id that has its string."""
    bucket, units, (seconds, ids, counts, windows) = _gathered(group)
    ask = [np.frombuffer(s, np.uint64) for s in seconds]
    count = [np.frombuffer(c, np.uint8).astype(np.int64) for c in counts]
    doc = np.concatenate([np.repeat(np.frombuffer(i, np.int64), c) for i, c in zip(ids, count, strict=True)])
    window = np.concatenate([np.frombuffer(w, np.uint64) for w in windows])
    _, inverse = np.unique(window, return_inverse=True)
    least = np.full(inverse.max() + 1 if len(inverse) else 0, NO_ID)
    np.minimum.at(least, inverse, doc)
    value = least[inverse]
    all_ask, all_count = np.concatenate(ask), np.concatenate(count)
    begin = np.cumsum(all_count) - all_count
    published = np.flatnonzero(all_count)
    known, where = np.unique(all_ask[published], return_index=True)
    rows = []
    for unit, s in zip(units, ask, strict=True):
        source = published[where[np.searchsorted(known, s)]]
        n = all_count[source]
        take = np.repeat(begin[source] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows.append((unit, bucket, s, n.astype(np.uint8), value[take]))
    return _reply(WINDOWS, rows)


class Answers:
    """What the replies of all passes so far say about a unit."""

    def __init__(self, replies: pa.Table) -> None:
        kinds = replies.column("kind").to_numpy() if replies.num_rows else np.zeros(0, np.int32)

        def of(kind: int, column: str, dtype: type) -> list[np.ndarray]:
            return [np.frombuffer(replies.column(column)[int(i)].as_buffer(), dtype) for i in np.flatnonzero(kinds == kind)]

        def joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
            return np.concatenate(parts) if parts else np.zeros(0, dtype)

        buckets = replies.column("bucket").to_numpy()[kinds == ALIVE] if replies.num_rows else np.zeros(0, np.int64)
        digits = of(ALIVE, "x", np.uint32)
        self.alive = np.unique(joined([(np.uint64(b) << np.uint64(32)) | d.astype(np.uint64) for b, d in zip(buckets, digits, strict=True)], np.uint64))
        seconds = joined(of(FOUND, "x", np.uint64), np.uint64)
        self.seconds, at = np.unique(seconds, return_index=True)
        self.least, self.mixed = joined(of(FOUND, "y", np.int64), np.int64)[at], joined(of(FOUND, "z", bool), bool)[at]
        asked, counts = joined(of(WINDOWS, "x", np.uint64), np.uint64), joined(of(WINDOWS, "y", np.uint8), np.uint8).astype(np.int64)
        self.windows = joined(of(WINDOWS, "z", np.int64), np.int64)
        self.asked, at = np.unique(asked, return_index=True)
        self.window_begin = (np.cumsum(counts) - counts)[at]

    def resolved(self, s: Survivors) -> tuple[np.ndarray, np.ndarray]:
        """Smallest doc_id of each entry, and whether its first digit has several second ones."""
        at = _place(self.seconds, s.second)
        if not len(self.seconds):
            return s.least, np.zeros(len(s.least), bool)
        return np.where(at >= 0, self.least[at], s.least), (at >= 0) & self.mixed[at]


def _first(unit: pa.Table, buckets: int) -> pa.Table:
    found = [b.first_digits(buckets)[:2] for b in _blocks(unit)]
    digits, several = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(digits, kind="stable")
    digits, several = digits[order], several[order]
    begin = np.flatnonzero(np.concatenate([[True], digits[1:] != digits[:-1]])) if len(digits) else np.zeros(0, np.int64)
    if len(digits):
        several = np.logical_or.reduceat(several, begin) | (np.diff(np.append(begin, len(digits))) > 1)
    digits = digits[begin]
    return _by_bucket(unit.column("unit")[0].as_py(), digits >> np.uint64(32), {"digits": digits.astype(np.uint32), "several": several})


def _second(unit: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    answers = Answers(replies)
    found = [(s.digit, s.second, s.least) for b in _blocks(unit) for s in [Survivors(b, buckets, answers.alive)]]
    digit, second, least = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((least, second, digit))
    digit, second, least = digit[order], second[order], least[order]
    new = np.ones(len(digit), bool)
    new[1:] = (digit[1:] != digit[:-1]) | (second[1:] != second[:-1])
    digit, second, least = digit[new], second[new], least[new]
    return _by_bucket(unit.column("unit")[0].as_py(), digit >> np.uint64(32), {"digits": digit.astype(np.uint32), "seconds": second, "ids": least})


def _third(unit: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    answers = Answers(replies)
    found = []
    for b in _blocks(unit):
        s = Survivors(b, buckets, answers.alive)
        least, mixed = answers.resolved(s)
        at = np.flatnonzero(mixed)
        run = s.sample[at]
        count = np.where(least[at] == s.least[at], b.count[run], 0)  # the smallest document publishes
        edge = np.append(0, np.cumsum(count))
        start = np.repeat(b.first[run] - edge[:-1], count) + np.arange(edge[-1])
        found.append((s.digit[at] >> np.uint64(32), s.second[at], s.least[at], count, b.hash(start, DEPTH, 7)))
    bucket, second, least, count, window = (np.concatenate([f[i] for f in found]) for i in range(5))
    begin = np.cumsum(count) - count
    order = np.lexsort((-count, second, bucket))
    keep = order[np.concatenate([[True], second[order][1:] != second[order][:-1]])] if len(order) else order
    n = count[keep]
    edge = np.append(0, np.cumsum(n))
    window = window[np.repeat(begin[keep] - edge[:-1], n) + np.arange(edge[-1])]
    columns = {"seconds": second[keep], "ids": least[keep], "counts": n.astype(np.uint8)}
    return _by_bucket(unit.column("unit")[0].as_py(), bucket[keep], columns, {"windows": (edge, window)})


class Finder:
    """The three passes over a table of units; ``answers`` holds what each unit must know to cut its texts."""

    def __init__(self, documents: DataFrame, keep: list[str]) -> None:
        self.spark = spark = documents.sparkSession
        self.scratch = Scratch(spark)
        self.schema = T.StructType([documents.schema[c] for c in keep])
        self.parts = shuffle_partitions(spark)
        columns = [F.col("doc_id").cast("bigint").alias("__id"), *(F.col(c) for c in keep if c != "text"), F.coalesce("text", F.lit("")).alias("text")]
        total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        unit_bytes = min(max(total // (3 * self.parts), UNIT_BYTES[0]), UNIT_BYTES[1])
        self.buckets = max(SPREAD * self.parts, int(total // BUCKET_BYTES) + 1)
        packed = documents.select(*columns).mapInArrow(lambda batches: _pack(batches, unit_bytes), "unit bigint, block int, payload binary").repartition(self.parts, "unit")
        name = f"millrace_{uuid.uuid4().hex}"
        writer = packed.write.bucketBy(self.parts, "unit").sortBy("unit").format("parquet")
        writer.option("compression", "none").option("path", self.scratch.path("units")).saveAsTable(name)
        self.units = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay in the scratch folder, and the plan knows them

    def _with_units(self, replies: DataFrame, run, schema: str) -> DataFrame:
        return self.units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(run, schema)

    def answers(self) -> DataFrame:
        n = self.buckets
        sent = self.units.groupBy("unit").applyInArrow(lambda unit: _first(unit, n), "bucket bigint, unit bigint, digits binary, several binary")
        replies = self.scratch.save(sent.groupBy("bucket").applyInArrow(_first_reduce, REPLY), "first")
        sent = self._with_units(replies, lambda unit, known: _second(unit, known, n), "bucket bigint, unit bigint, digits binary, seconds binary, ids binary")
        replies = replies.unionByName(self.scratch.save(sent.groupBy("bucket").applyInArrow(_second_reduce, REPLY), "second"))
        schema = "bucket bigint, unit bigint, seconds binary, ids binary, counts binary, windows binary"
        sent = self._with_units(replies, lambda unit, known: _third(unit, known, n), schema)
        return replies.unionByName(self.scratch.save(sent.groupBy("bucket").applyInArrow(_third_reduce, REPLY), "third"))

    def cut(self, fields: list[T.StructField], finish) -> DataFrame:
        """The kept columns but the text, and what ``finish`` makes of (bytes of a text, removed flags, starts and ends of the spans)."""
        n, buckets = len(self.schema.fields), self.buckets
        names = [f.name for f in self.schema.fields if f.name != "text"]
        schema = T.StructType([self.schema[c] for c in names] + fields)

        def last(unit, replies):
            answers, out = Answers(replies), []
            for b in _blocks(unit):
                removed = _removed(b, buckets, answers)
                values = []
                for i in range(len(b.ids)):
                    part = slice(b.starts[i], b.ends[i])
                    flags = removed[part]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
                    values.append(finish(b.data[part], flags, edge[::2], edge[1::2]))
                columns = [pa.array(c, _arrow(f)) for c, f in zip(zip(*values, strict=True), fields, strict=True)]
                out.append(pa.RecordBatch.from_arrays([b.batch.column(1 + i) for i in range(n - 1)] + columns, names=[*names, *(f.name for f in fields)]))
            return pa.Table.from_batches(out)

        return self._with_units(self.answers(), last, schema)


def _arrow(field: T.StructField) -> pa.DataType:
    return pa.int64() if isinstance(field.dataType, T.LongType) else pa.string()


def _removed(b: Block, buckets: int, answers: Answers) -> np.ndarray:
    """For each byte of the block whether a string that a smaller doc_id has too covers it."""
    total = int(b.ends[-1]) if len(b.ends) else 0
    starts = np.zeros(total + DEPTH + 1, np.int32)
    if len(answers.alive):
        s = Survivors(b, buckets, answers.alive)
        least, mixed = answers.resolved(s)
        ids = b.ids[b.doc[s.run]]
        plain = ~mixed[s.entry] & (least[s.entry] < ids)
        first, count = b.first[s.run[plain]], b.count[s.run[plain]]
        where = [np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
        if mixed.any():
            begin = answers.window_begin[_place(answers.asked, s.second[s.entry])] if len(answers.asked) else None
            run = np.flatnonzero(mixed[s.entry])
            count = b.count[s.run[run]]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            smaller = answers.windows[np.repeat(begin[run], count) + step] < np.repeat(ids[run], count)
            where.append((np.repeat(b.first[s.run[run]], count) + step)[smaller])
        at = np.concatenate(where)
        starts[at] += 1
        starts[at + DEPTH] -= 1
    return np.cumsum(starts[:total]) > 0


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]

    def finish(data, flags, begin, end):
        return len(data), int((end - begin).sum()), len(begin), hashlib.sha256(data[~flags].tobytes()).hexdigest()

    return Finder(documents.select("doc_id", "text"), ["doc_id", "text"]).cut(fields, finish)


def strip(documents: DataFrame) -> DataFrame:
    """``documents`` without the repeated strings; characters that a cut splits go too. Columns as they are; n_chars is recounted."""
    others = [c for c in documents.columns if c != "text"]

    def finish(data, flags, begin, end):
        return (data[~flags].tobytes().decode("utf-8", "ignore"),)

    out = Finder(documents, [*others, "text"]).cut([T.StructField("text", T.StringType())], finish)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
