"""Overlapping chunks of texts: whole words up to a number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_text(text: str, size: int = 512, overlap: int = 64, strict: bool = False) -> list[tuple[str, int, int]]:
    """(chunk, start, end) with byte places in the text.

    A text of at most ``size`` bytes is one chunk as it is. Else words are joined by single blanks while they fit, and
    the next chunk starts where at least ``overlap`` bytes of words repeat: one word even for 0, unless ``strict``.
    """
    raw = text.encode()
    if not raw:
        return []
    if len(raw) <= size:
        return [(text, 0, len(raw))]
    words, at = [], 0
    for word in text.split():
        w = word.encode()
        at = raw.index(w, at)
        words.append((word, at, at + len(w)))
        at += len(w)
    out, first = [], 0
    while first < len(words):
        last, length = first, len(words[first][0].encode())
        while last + 1 < len(words) and length + 1 + len(words[last + 1][0].encode()) <= size:
            last += 1
            length += 1 + len(words[last][0].encode())
        out.append((" ".join(w for w, _, _ in words[first : last + 1]), words[first][1], words[last][2]))
        if last + 1 == len(words):
            break
        back, repeated = last + 1, 0
        while back > first + 1 and not (strict and not overlap):
            back -= 1
            repeated += len(words[back][0].encode()) + (1 if repeated else 0)
            if repeated >= overlap:
                break
        first = max(back, first + 1)
    return out


def chunk_rows(rows: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(columns of ``rows`` but text, idx, chunk, start_byte, end_byte): a row for each chunk; null and empty texts have none."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [(r, i, *c) for r, t in enumerate(part.column(part.num_columns - 1).to_pylist()) for i, c in enumerate(chunk_text(t or "", size, overlap))]
                of, *columns = list(zip(*found, strict=True)) or [[]] * 5
                of = pa.array(of, pa.int32())
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                arrays = [part.column(i).take(of) for i in range(len(kept))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "idx", "chunk", "start_byte", "end_byte"])

    added = T.StructType().add("idx", T.IntegerType()).add("chunk", T.StringType()).add("start_byte", T.LongType()).add("end_byte", T.LongType())
    return rows.select(*kept, "text").mapInArrow(run, T.StructType([*rows.select(*kept).schema.fields, *added.fields]))


def chunks(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, idx, chunk, start_byte, end_byte) of every document."""
    return chunk_rows(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), size, overlap)
