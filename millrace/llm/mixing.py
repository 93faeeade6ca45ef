"""Mixing sources to target weights by Pareto order sampling.

A document of a source is expected ``most`` times at most, and otherwise so often that the words expected of the
source are its target: ``level`` times a factor that grows with the document's size (a quarter of the exponent, by
classes of sizes that double), so longer documents of a source have larger inclusion probabilities. The whole part
of what is expected are certain copies; for the rest documents are ranked by random odds divided by their inclusion
odds, and those are taken whose words, summed in this order, fit in what is left of the source's target (fixed
size). The gap that stays, less than the next document, is filled by the first further document of the order that
brings the sum within ``NEAR`` of the target, or, if none does, by the one that brings it nearest.

No source is ever sorted in one task: ranks are cut into buckets, sums of buckets are accumulated by source, and
only rows of one bucket are sorted together. What comes back is one threshold per source, so the documents
themselves are never shuffled.

Defined cases: null text has size 0; a null source is a source of its own, the last in order; a source without
words has target 0; rows with equal id (or none) and different texts have ranks of their own; rows with equal id and text share a rank, and
as many of them are taken as the target wants, told apart by their place in the scan; empty tables give empty
results; extra columns are kept by ``mix`` and not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

WEIGHTS = (3, 1, 2)  # by order of the sources, repeating
TOTAL = 1.5  # share of all words that the mix takes
MOST = 2.0  # times that a document is taken at most
SEED = 9
SPACE = "[\\x20\\x09-\\x0D]"
SLOPE = 0.25  # inclusion grows with size to this power
NEAR = 0.001  # of a target
SMALL_SOURCES = 10_000  # up to so many sources their table is broadcast, with a row for each class of sizes


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newlines, form feed and vertical tab."""
    parts = F.size(F.split(text, f"{SPACE}+"))
    edge = F.when(text.rlike(f"^{SPACE}"), 1).otherwise(0) + F.when(text.rlike(f"{SPACE}\\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts - edge).cast("bigint")


def uniform(doc_id: Column, words: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the text alone (by the text's hash ``words``)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, words), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target): weights share ``total`` of all words, no source over ``most`` times its size.

    Sources fill up in the order of their cap per weight; the level at which the rest shares is found with running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", F.lit(most) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn(
        "level",
        (F.lit(total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    ).withColumn("rank", F.row_number().over(filling))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rank", "level"))
    by = by.withColumn("level", F.min(fits).over(whole)["level"])
    return by.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def _class(size: Column) -> Column:
    """-1 for no words, else the whole part of the size's binary logarithm."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def _expected(sized: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, class, expected): times that documents are expected. Classes reach ``most`` in the order of their factors."""
    factor = F.pow(F.lit(2.0), F.col("class") * F.lit(SLOPE))
    by = sized.groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")).withColumn("factor", factor)
    by = by.join(sources.select(F.col("source").alias("__s"), "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    full = F.coalesce(F.sum(F.lit(most) * F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("factor")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("full", full).withColumn("rest", rest).withColumn("level", F.when(F.col("rest") > 0, F.greatest(F.col("target") - F.col("full"), F.lit(0.0)) / F.col("rest")))
    fits = F.when(F.col("level") * F.col("factor") <= most, F.struct((-F.col("class")).alias("place"), "level"))
    whole = Window.partitionBy("source")
    by = by.withColumn("level", F.min(fits).over(whole)["level"])
    return by.select("source", "class", "words", F.when(F.col("words") > 0, F.least(F.coalesce(F.col("level") * F.col("factor"), F.lit(most)), F.lit(most))).otherwise(0.0).alias("expected"))


def _copies(sized: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, class, source_size, n_docs, target, certain, odds, rest_words): certain copies, the inclusion odds of the rest, and its words in the source."""
    by = _expected(sized, sources, most)
    certain = F.floor(F.col("expected") + 1e-12)
    by = by.withColumn("certain", certain).withColumn("rest", F.greatest(F.col("expected") - F.col("certain"), F.lit(0.0)))
    by = by.withColumn("rest_words", F.sum(F.col("rest") * F.col("words")).over(Window.partitionBy("source")))
    by = by.select("source", "class", "certain", (F.col("rest") / (1 - F.col("rest"))).alias("odds"), "rest_words")
    return by.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def _keyed(documents: DataFrame) -> DataFrame:
    """Adds the text's hash, and what orders rows whose id and text are equal: any row of them will do."""
    return documents.withColumn("__words", F.xxhash64("text")).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))


def _rank() -> Column:
    u = uniform(F.col("doc_id"), F.col("__words"))
    return F.when(F.col("odds") > 0, u / (1 - u) / F.col("odds"))


def _with_sources(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Adds what is known of the source and class of ``__size`` to each row."""
    s = (F.broadcast(sources) if n <= SMALL_SOURCES else sources).withColumnsRenamed({"source": "__source", "class": "__class"})
    return df.join(s, F.col("source").eqNullSafe(F.col("__source")) & (_class(F.col("__size")) == F.col("__class")), "left").drop("__source", "__class", "__size")


def plan(documents: DataFrame, scratch: Scratch, most: float = MOST, **options) -> tuple[DataFrame, DataFrame, int]:
    """(sized documents, table of sources with thresholds, number of sources)."""
    sized = _keyed(documents.select("doc_id", "source", "text"))
    sized = scratch.save(sized.select("doc_id", "source", word_count(F.col("text")).alias("size"), "__words", "__tie"), "sized")
    sources = scratch.save(targets(sized, most=most, **options), "targets")
    n, docs = sources.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    sources = scratch.save(_copies(sized, sources, most), "sources")
    buckets = min(max(256, (docs or 0) // 2000), 100_000)
    ranked = _with_sources(sized.where(F.col("size") > 0).withColumn("__size", F.col("size")), sources, n).where(F.col("odds") > 0)
    ranked = ranked.select("source", "size", "rest_words", "target", _rank().alias("rank"), "__tie")
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest_words").alias("rest_words"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    split = sums.where((F.col("before") <= F.col("rest_words")) & (F.col("before") + F.col("words") > F.col("rest_words")))
    split = split.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before")
    inside = ranked.join(F.broadcast(split) if n <= SMALL_SOURCES else split, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("rank", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    inside = inside.withColumn("sum", F.col("before") + F.col("size")).where(F.col("sum") <= F.col("rest_words"))
    last = inside.groupBy("source").agg(F.max(F.struct("rank", "__tie")).alias("last"), F.max("sum").alias("sum"))
    whole = sums.withColumn("sum", F.col("before") + F.col("words")).where(F.col("sum") <= F.col("rest_words"))
    full = whole.groupBy("source").agg(F.max("bucket").alias("full"), F.max("sum").alias("sum"))
    bounds = scratch.save(_bounds(full, last), "bounds")
    small = F.broadcast(bounds) if n <= SMALL_SOURCES else bounds
    others = ranked.join(small, F.col("source").eqNullSafe(F.col("__source")), "left")
    gap = F.col("rest_words") - F.coalesce("sum", F.lit(0))
    others = others.where(~F.coalesce(_chosen(F.col("bucket"), F.col("rank"), F.col("__tie")), F.lit(False)) & (F.abs(gap - F.col("size")) < gap))
    off = F.greatest(F.abs(gap - F.col("size")) - NEAR * F.col("target"), F.lit(0.0))
    extra = others.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "__tie")).alias("extra"))
    extra = scratch.save(extra.select(F.col("source").alias("__extra"), F.col("extra.rank").alias("extra_rank"), F.col("extra.__tie").alias("extra_tie")), "extra")
    out = sources.join(bounds, sources["source"].eqNullSafe(bounds["__source"]), "left").drop("__source", "sum")
    out = out.join(extra, out["source"].eqNullSafe(extra["__extra"]), "left").drop("__extra")
    return sized, scratch.save(out.withColumn("buckets", F.lit(buckets)), "thresholds"), n


def _bounds(full: DataFrame, last: DataFrame) -> DataFrame:
    """(source, largest bucket taken whole, largest rank taken, sum of the words of both)."""
    both = full.select("source", "full", F.lit(None).cast("struct<rank: double, __tie: bigint>").alias("last"), "sum").unionByName(
        last.select("source", F.lit(None).cast("bigint").alias("full"), "last", "sum")
    )
    return both.groupBy("source").agg(F.max("full").alias("full"), F.max("last").alias("last"), F.max("sum").alias("sum")).withColumnRenamed("source", "__source")


def _chosen(bucket: Column, rank: Column, tie: Column) -> Column:
    last = F.col("last")
    before = (rank < last["rank"]) | ((rank == last["rank"]) & (tie <= last["__tie"]))
    return F.coalesce(bucket <= F.col("full"), F.lit(False)) | F.coalesce(before, F.lit(False))


def _taken_copies(size: Column) -> Column:
    rank, tie = _rank(), F.col("__tie")
    bucket = F.floor(rank / (1 + rank) * F.col("buckets"))
    extra = (rank == F.col("extra_rank")) & (tie == F.col("extra_tie"))
    chosen = (size > 0) & (_chosen(bucket, rank, tie) | F.coalesce(extra, F.lit(False)))
    return F.coalesce(F.col("certain"), F.lit(0)) + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)


def takes(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sized, sources, n = plan(documents, Scratch(documents.sparkSession), **options)
    out = _with_sources(sized.withColumn("__size", F.col("size")), sources, n)
    return out.select("doc_id", "size", "source_size", "target", (_taken_copies(F.col("size")) * F.col("size")).cast("bigint").alias("taken"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as they are. Documents without words are in it once."""
    _, sources, n = plan(documents, Scratch(documents.sparkSession), **options)
    names = ["source_size", "n_docs", "target", "certain", "odds", "rest_words", "full", "last", "extra_rank", "extra_tie", "buckets"]
    clash = {c: f"__kept_{c}" for c in documents.columns if c in names}
    out = _with_sources(_keyed(documents.withColumnsRenamed(clash)).withColumn("__size", word_count(F.col("text"))), sources, n)
    size = word_count(F.col("text"))
    copies = F.when(size > 0, _taken_copies(size)).otherwise(1)
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop("__copy", *names)
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*documents.columns)
