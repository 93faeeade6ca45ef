"""Phrase collocations: counts of all phrases by weighted acyclic automata, the worst cut of each, none that a longer one replaces.

Phrases are 1 to ``LONGEST`` words in a row within a piece of a text. Shards of ``SHARD_WORDS`` words sort their
phrases of one length and build a minimal automaton whose last arcs carry counts (``automata``). An automaton is cut
by prefix range: the place of a phrase in the lexicographic order of (lang, word ids), measured by the shares of its
words, so ranges hold about equal parts whatever the words; a frequent phrase is one path of each shard, and its
longer forms lie in the ranges of their own. A range unites its automata and keeps what reaches ``LEAST``. Three
passes read the texts: words; pairs of frequent words; phrases of three words and more whose pairs are all frequent.
No phrase is lost by that, as no part of a phrase is rarer than the phrase. The pairs come as a Bloom filter of at most
``FILTER_BITS`` bits, whose false alarms only make a range drop more. Parts are looked up by composition: each block of phrases
sends the automaton of its parts to the blocks where they lie, and these send it back with counts. The same
automata tell each phrase the count of the longest phrases around it: as counts never grow with the length, a phrase
is inside a longer one with its count if and only if it is so in one with one word more.

Word ids are ranks among the ``DICTIONARY`` most frequent words of all languages, which the driver and each task hold.
If more words than that are frequent, the others go by a 61-bit hash; a seed is searched under which no two words of
the data collide.

Defined cases: a null text is empty; a null lang is ``und``, together with a lang of that name; repeated rows count
each; very long texts are cut in slices between words and counted over the cuts; an empty table gives an empty
result; doc_id and other columns are not read. Memory of a task: about 100 bytes a word of a shard, and three times the
text that it is at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.automata import Automaton, summed, union
from millrace.llm.common import Scratch, shuffle_partitions

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_WORDS = 2_000_000
RANGE_WORDS = 1_000_000  # words of the corpus for each range
BLOCK_PHRASES = 10_000  # frequent phrases that are composed in one block, about
DICTIONARY = 1_000_000
FILTER_BITS = 1 << 28
SLICE = 1 << 22  # bytes of a text that are split at once
HASHED = 1 << 61
_WORDS = 500_000  # distinct words that a task counts before it passes them on
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(
    32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
RESULT = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
BLOBS = "lang string, size int, range int, blob binary"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, with ``_BREAK`` between pieces, some MB at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            ends = [x for x in (text.find(b" ", end), text.find(_BREAK, end)) if x >= 0]
            end = min(ends, default=len(text))
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(_BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = counts.setdefault(lang, Counter())
            for words in tokens(text.as_py()):
                own.update(words)
                if sum(map(len, counts.values())) > _WORDS:
                    yield from flush()
                    own = counts.setdefault(lang, Counter())
    yield from flush()


class Vocabulary:
    """Ids of words and places of phrases. Bounded by ``DICTIONARY`` words, whatever the data's size."""

    def __init__(self, rows: list[tuple[str, bytes, int]], totals: dict[str, int], total: int, ranges: int, whole: bool, seed: int) -> None:
        """rows: (lang, word, count), the most frequent first; totals: words of each lang in rows; whole: other words aren't frequent."""
        self.ids: dict[str, dict[bytes, int]] = {}
        self.whole, self.seed, self.ranges = whole, seed, ranges
        counts: dict[str, list[int]] = {}
        for lang, word, f in rows:
            own = self.ids.setdefault(lang, {})
            own[word] = len(own)
            counts.setdefault(lang, []).append(f)
        self.shares, self.begins, self.known, self.start = {}, {}, {}, {}
        at = 0
        for lang in sorted(counts):
            share = np.array(counts[lang]) / totals[lang]
            self.shares[lang], self.begins[lang] = share, np.cumsum(share) - share
            self.known[lang] = float(share.sum())
            self.start[lang] = at / total, totals[lang] / total
            at += totals[lang]
        for own in self.ids.values():
            own[_BREAK] = -2

    def hash(self, word: bytes) -> int:
        return HASHED | (xxhash.xxh3_64_intdigest(word, self.seed) & (HASHED - 1))

    def encode(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Ids; below 0 where no frequent word is."""
        out = np.fromiter(map(self.ids.get(lang, {_BREAK: -2}).get, words, repeat(-1)), np.int64, len(words))
        if not self.whole:
            for i in np.flatnonzero(out == -1):
                out[i] = self.hash(words[i])
        return out

    def places(self, lang: str, rows: np.ndarray) -> np.ndarray:
        """The range of each phrase: a function of the phrase alone, growing with the order of ids."""
        n = len(rows)
        if lang not in self.start:
            return np.full(n, zlib.crc32(lang.encode()) % self.ranges, np.int64)
        at, width = (np.full(n, x) for x in self.start[lang])
        share, begin, known = self.shares[lang], self.begins[lang], self.known[lang]
        for column in rows.T:
            named = column < HASHED
            index = np.where(named, column, 0)
            other = known + (1 - known) * ((column & (HASHED - 1)) / HASHED)
            at += width * np.where(named, begin[index], other)
            width *= np.where(named, share[index], 0.0)
        return np.clip((at * self.ranges).astype(np.int64), 0, self.ranges - 1)


def _cut(lang: str, rows: np.ndarray, weights: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place, automaton) of sorted phrases."""
    order = np.argsort(places, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(places[order])) + 1, len(order))
    begin = 0
    for end in ends if len(order) else ():
        some = order[begin:end]
        yield int(places[some[0]]), Automaton.build(rows[some], weights[some]).dump()
        begin = end


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "size", "range", "blob"])


def _pair_bits(lang: str, first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of each pair in a filter of that many bits (a power of two)."""
    with np.errstate(over="ignore"):
        h = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) + np.uint64(zlib.crc32(lang.encode()) << 20)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _starts(lang: str, ids: np.ndarray, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places in ids where a phrase of that length begins): pairs without a filter, longer phrases with it."""
    pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
    if bits is None:
        yield 2, np.flatnonzero(pair)
        return
    at = np.flatnonzero(pair)
    for some in _pair_bits(lang, ids[at], ids[at + 1], 8 * len(bits)):
        inside = (bits[some >> 3] >> (some & 7).astype(np.uint8)) & 1 == 1
        pair[at[~inside]] = False
    run = pair
    for size in range(3, LONGEST + 1):
        run = run[:-1] & pair[size - 2 :]
        yield size, np.flatnonzero(run)


def _shards(vocabulary, filter_bits):
    """A function for mapInArrow: automata of the phrases of each shard, cut by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        bits = None if filter_bits is None else filter_bits.value
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def flush(inside: str | None) -> Iterator[pa.RecordBatch]:
            """Counts what is held. A text that goes on keeps its last words, where no phrase was begun."""
            for lang in list(held):
                ids = np.concatenate(held.pop(lang))
                goes_on = lang == inside
                for size, at in _starts(lang, ids, bits):
                    if goes_on:
                        at = at[at < len(ids) - LONGEST + 1]
                    rows, counts = summed(np.stack([ids[at + k] for k in range(size)], 1), np.ones(len(at), np.int64))
                    found = [(lang, size, *x) for x in _cut(lang, rows, counts, v.places(lang, rows))]
                    if found:
                        yield _blobs(found)
                if goes_on:
                    held[lang] = [ids[max(0, len(ids) - LONGEST + 1) :]]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v.whole and lang not in v.ids:
                    continue
                for words in tokens(text.as_py()):
                    held.setdefault(lang, []).append(v.encode(lang, words))
                    n += len(words)
                    if n >= SHARD_WORDS:
                        yield from flush(lang)
                        n = 0
                held.setdefault(lang, []).append(np.full(1, -2, np.int64))
        yield from flush(None)

    return run


def _united(least: int):
    """A function for applyInArrow: one automaton of a range, without rare phrases."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows, weights = union([Automaton.load(b.as_py()) for b in group.column("blob")])
        often = weights >= least
        found = [(*(k.as_py() for k in key), Automaton.build(rows[often], weights[often]).dump())] if often.any() else []
        return pa.Table.from_batches([_blobs(found)]) if found else pa.Table.from_batches([], schema=_ARROW)

    return run


_ARROW = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("range", pa.int32()), ("blob", pa.binary())])


def _frequent(shards: DataFrame, least: int) -> DataFrame:
    return shards.groupBy("lang", "size", "range").applyInArrow(_united(least), BLOBS)


def _filter(pairs: DataFrame) -> np.ndarray:
    """The Bloom filter of frequent pairs, put together by Spark's bitmaps of 4 KB."""
    n = pairs.agg(F.sum("phrases")).first()[0] or 0
    bits = FILTER_BITS
    while bits > 65_536 and bits >= 128 * n:
        bits //= 2

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, _ = Automaton.load(blob.as_py()).rows()
                for at in _pair_bits(lang, rows[:, 0], rows[:, 1], bits):
                    yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])

    at = pairs.select("lang", "blob").mapInArrow(positions, "at bigint")
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():  # bits / 32768 rows at most
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["map"], np.uint8)
    return out


def _sizes(blobs: DataFrame) -> DataFrame:
    """Adds the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(Automaton.load(b.as_py()).rows()[1]) for b in batch.column("blob")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "phrases"])

    return blobs.mapInArrow(run, BLOBS + ", phrases bigint")


def _parts(rows: np.ndarray, weights: np.ndarray) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Both parts of each cut by length; the weight is that of the phrase where one word is left out, else 0."""
    width, out = rows.shape[1], {}
    for k in range(1, width):
        for part in (rows[:, :k], rows[:, k:]):
            w = weights if part.shape[1] == width - 1 else np.zeros_like(weights)
            out.setdefault(part.shape[1], []).append((part, w))
    return out


ASKED = "lang string, size int, block int, home int, blob binary"
FOUND = "lang string, ids array<bigint>, a bigint, l bigint, r bigint, score bigint"


def _by_size(table: pa.Table) -> dict[tuple[str, int], list[dict]]:
    out: dict[tuple[str, int], list[dict]] = {}
    for row in table.to_pylist():
        out.setdefault((row["lang"], row["size"]), []).append(row)
    return out


def _asked(rows: list[tuple]) -> pa.Table:
    kinds = {"lang": pa.string(), "size": pa.int32(), "block": pa.int32(), "home": pa.int32(), "blob": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _ask(vocabulary, blocks: int):
    """Of a block: the automata of the parts that it asks for, by the block where they lie."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        v, out = vocabulary.value, []
        wanted: dict[tuple[str, int], list] = {}
        for (lang, size), rows in _by_size(group).items():
            if size > 1:
                for n, parts in _parts(*union([Automaton.load(r["blob"]) for r in rows])).items():
                    wanted.setdefault((lang, n), []).extend(parts)
        for (lang, size), parts in wanted.items():
            rows, weights = summed(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]), np.maximum)
            for block, blob in _cut(lang, rows, weights, v.places(lang, rows) * blocks // v.ranges):
                out.append((lang, size, block, key[0].as_py(), blob))
        return _asked(out)

    return run


def _answer(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
    """Of a block: what is asked, with counts; for itself (size below 0) the phrases that one with a word more replaces."""
    block, out = key[0].as_py(), []
    counts = {k: Automaton.build(*union([Automaton.load(r["blob"]) for r in rows])) for k, rows in _by_size(own).items()}
    for (lang, size), rows in _by_size(asked).items():
        replaced = []
        for row in rows:
            paths, longer = Automaton.load(row["blob"]).rows()
            f = counts[lang, size].weights(paths)
            out.append((lang, size, row["home"], block, Automaton.build(paths, f).dump()))
            replaced.append(paths[(longer > 0) & (longer >= f)])
        paths = np.concatenate(replaced)
        if len(paths):
            out.append((lang, -size, block, block, Automaton.build(*summed(paths, np.ones(len(paths), np.int64), np.maximum)).dump()))
    return _asked(out)


def _judge(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
    """Of a block: its phrases that no longer one replaces, with their lowest cut. Products are Python's integers."""
    known = {k: Automaton.build(*union([Automaton.load(r["blob"]) for r in rows], np.maximum)) for k, rows in _by_size(answers).items()}
    out: list[tuple] = []
    for (lang, size), blobs in _by_size(own).items():
        if size < 2:
            continue
        rows, a = union([Automaton.load(r["blob"]) for r in blobs])
        if (lang, -size) in known:
            stays = known[lang, -size].weights(rows) == 0
            rows, a = rows[stays], a[stays]
        n = int(blobs[0]["n"])
        cuts = [(known[lang, k].weights(rows[:, :k]).tolist(), known[lang, size - k].weights(rows[:, k:]).tolist()) for k in range(1, size)]
        for i, (ids, count) in enumerate(zip(rows.tolist(), a.tolist(), strict=True)):
            score, k = min((1000 * count * n // (left[i] * right[i]), k) for k, (left, right) in enumerate(cuts))
            out.append((lang, ids, count, cuts[k][0][i], cuts[k][1][i], score))
    kinds = (pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 4)
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "ids", "a", "l", "r", "score"])


def _vocabulary(words: DataFrame, least: int, ranges) -> Vocabulary | None:
    """From (lang, word, f). The driver holds ``DICTIONARY`` words at most."""
    often = words.where(F.col("f") >= least)
    n = often.count()
    if not n:
        return None
    table = often.orderBy(F.desc("f"), "lang", "word").limit(DICTIONARY).toArrow()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("lang", "word", "f")), strict=True))
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = sums.agg(F.sum("n")).first()[0]
    langs = words.sparkSession.createDataFrame([(x,) for x in {r[0] for r in rows}], "lang string")
    totals = {r["lang"]: r["n"] for r in sums.join(langs, "lang", "left_semi").collect()}
    whole = n <= DICTIONARY
    for seed in range(1 if whole else 64):
        found = Vocabulary(rows, totals, total, ranges(total), whole, seed)
        if whole or not _collides(words, found):
            return found
    raise ValueError("no seed found under which hashes of words differ")


def _collides(words: DataFrame, vocabulary: Vocabulary) -> bool:
    v = words.sparkSession.sparkContext.broadcast(vocabulary)
    ids = _with_ids(words, v).where(F.col("id") >= HASHED).groupBy("lang", "id").count()
    return bool(ids.where("count > 1").take(1))


def _with_ids(words: DataFrame, vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            ids = [int(v.encode(lang, [w])[0]) for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=["lang", "word", "f", "id"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word binary, f bigint, id bigint")


def _single(vocabulary):
    """Automata of single words, from rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            langs, f, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs):
                own = langs == lang
                rows, counts = summed(ids[own].astype(np.int64)[:, None], f[own].astype(np.int64))
                yield _blobs([(lang, 1, *x) for x in _cut(lang, rows, counts, v.places(lang, rows))])

    return run


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    spark = documents.sparkSession
    scratch, texts = Scratch(spark), _texts(documents)
    words = scratch.save(texts.mapInArrow(_count_words, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    found = _vocabulary(words, least, lambda total: max(shuffle_partitions(spark), -(-total // RANGE_WORDS)))
    if found is None:
        return spark.createDataFrame([], RESULT)
    v = spark.sparkContext.broadcast(found)
    named = scratch.save(_with_ids(words.where(F.col("f") >= least), v), "named")
    pairs = scratch.save(_sizes(_frequent(texts.mapInArrow(_shards(v, None), BLOBS), least)), "pairs")
    bits = spark.sparkContext.broadcast(_filter(pairs))
    longer = scratch.save(_sizes(_frequent(texts.mapInArrow(_shards(v, bits), BLOBS), least)), "longer")
    single = _frequent(named.select("lang", "f", "id").mapInArrow(_single(v), BLOBS), least)
    phrases = pairs.unionByName(longer)
    blocks = max(1, min(found.ranges, -(-(phrases.agg(F.sum("phrases")).first()[0] or 0) // BLOCK_PHRASES)))
    block = F.expr(f"cast(range AS bigint) * {blocks} DIV {found.ranges}").cast("int")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    every = phrases.drop("phrases").unionByName(single).join(totals, "lang").withColumn("block", block)
    every = scratch.save(every, "blocks")
    asked = scratch.save(every.groupBy("block").applyInArrow(_ask(v, blocks), ASKED), "asked")
    answers = every.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_answer, ASKED)
    judged = every.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_judge, FOUND)
    judged = judged.withColumn("best", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("best") <= top).drop("best")
    judged = scratch.save(judged, "judged")
    spelt = judged.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(named.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "ids").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    spelt = spelt.select("lang", "ids", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = judged.join(spelt, ["lang", "ids"]).join(totals, "lang").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
