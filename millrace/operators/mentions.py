"""Names as substrings of texts, found by automata of the names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 8 << 20  # of names in one automaton: a task holds one at a time, some 30 bytes a byte of names


def text_key(text: Column) -> Column:
    """Stands for a text in joins and groups."""
    return F.unhex(F.sha2(text, 256))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name, n): each distinct text of ``text``, the distinct names of ``name`` in it, and how many rows have the text.

    Names are cut in shards of ``SHARD_BYTES`` by a hash; each becomes an Aho-Corasick automaton that reads every text
    once, whatever the number of names and of their lengths. The driver holds one shard at a time. Null texts and names
    are left out; the empty name is in every text.
    """
    names = names.select(F.col("name").cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()
    size = names.agg(F.sum(F.octet_length("name") + 8)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = texts.where(F.col("text").isNotNull()).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(text_key(F.col("text")).alias("key"), "n", "text")
    dealt = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    found = []
    for shard in range(shards):
        some = dealt.where(F.col("shard") == shard).select("name").toArrow().column("name").to_pylist()
        held = texts.sparkSession.sparkContext.broadcast(some)
        found.append(rows.mapInArrow(_reader(held), "key binary, name string, n bigint"))
    return reduce(DataFrame.unionByName, found)


def _reader(names):
    """A function for mapInArrow that finds the names of a broadcast list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in filter(None, names.value):
            automaton.add_word(name, name)
        automaton.make_automaton()
        everywhere = {""} & set(names.value)
        for batch in batches:
            of, found = [], []
            for i, text in enumerate(batch.column(2)):
                here = set(everywhere)
                if len(automaton):
                    here.update(name for _, name in automaton.iter(text.as_py()))
                of += [i] * len(here)
                found += sorted(here)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(found, pa.string()), batch.column(1).take(take)], names=["key", "name", "n"])

    return run
