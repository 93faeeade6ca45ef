"""Key phrases from term statistics and a co-occurrence graph, as DataFrame stages (documents: doc_id, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import phrases as P

# English function words; pass a longer list, such as that of ``stopwords``, for real use.
STOPWORDS = (
    "a", "about", "all", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "for", "from", "had", "has",
    "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "or", "our", "she", "so",
    "that", "the", "their", "them", "then", "there", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who",
    "will", "with", "would", "you",
)


def stopwords(*languages: str) -> tuple[str, ...]:
    """Spark's own stop words of these languages (English and Russian by default), in lower case and order, each once."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted({w.lower() for name in languages or ("english", "russian") for w in StopWordsRemover.loadDefaultStopWords(name)}))


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, sent, at, word, tag, term, y_word, y_tag, y_term, x_...): words between punctuation, with the one (y) and two (x) before each in its block.

    Texts are dealt by doc_id once. All of a sentence is told within its row, so what follows needs no sort, and sums by
    document and term need no further shuffle.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
    rows = rows.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent", "s"))
    rows = rows.select("doc_id", "sent", X.tokens(F.col("s")).alias("w"))
    rows = rows.select("doc_id", "sent", "w", F.transform("w", X.is_punctuation).alias("marks"))
    is_mark = lambda i: F.coalesce(F.get("marks", i), F.lit(False))

    def told(word: Column, i: Column) -> Column:
        word_at = lambda k: F.when(i >= k, F.get("w", i - k))
        y = F.when(~is_mark(i - 1), word_at(1))
        x = F.when(~is_mark(i - 1) & ~is_mark(i - 2), word_at(2))
        return F.struct(i.alias("at"), (i - _first()).alias("place"), word.alias("word"), y.alias("y_word"), x.alias("x_word"))

    found = F.filter(F.transform("w", told), lambda t: ~is_mark(t["at"]))
    rows = rows.select("doc_id", "sent", F.inline(found))
    forms = lambda prefix, back: [X.tag(F.col(f"{prefix}word"), F.col("place") - back).alias(f"{prefix}tag"), X.normalise(F.col(f"{prefix}word")).alias(f"{prefix}term")]
    return rows.select("doc_id", "sent", "at", "word", *forms("", 0), "y_word", *forms("y_", 1), "x_word", *forms("x_", 2))


def _first() -> Column:
    """Place of the first word of a sentence by its ``marks``: what comes after it is inside."""
    return (F.array_position("marks", False) - 1).cast("int")


def sentence_counts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sents"))


def is_stopword(word: Column, term: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    plain = F.length(F.regexp_replace(term, "[!-/:-@\\[-`{-~]", ""))
    return F.lower(word).isin(*stopwords) | term.isin(*stopwords) | (plain < 3)


def terms(tokens: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(doc_id, term, tf, tf_a, tf_n, n_sents, median_sent, stop): stop is told by the first occurrence."""
    place = F.struct("sent", "at")
    return tokens.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"),
        F.sum(F.when(F.col("tag") == "a", 1).otherwise(0)).alias("tf_a"),
        F.sum(F.when(F.col("tag") == "n", 1).otherwise(0)).alias("tf_n"),
        F.collect_set("sent").alias("sents"),
        F.min_by(is_stopword(F.col("word"), F.col("term"), stopwords), place).alias("stop"),
    ).select("doc_id", "term", "tf", "tf_a", "tf_n", F.size("sents").cast("bigint").alias("n_sents"), _median("sents").alias("median_sent"), "stop")


def _median(name: str) -> Column:
    return F.transform(
        F.array(F.sort_array(name)),
        lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2.0,
    )[0]


def edges(tokens: DataFrame) -> DataFrame:
    """(doc_id, a, b, weight): neighbours in a block, neither of them a number or mixed."""
    rows = tokens.where("y_word IS NOT NULL AND y_tag NOT IN ('u', 'd') AND tag NOT IN ('u', 'd')").select("doc_id", F.col("y_term").alias("a"), F.col("term").alias("b"))
    return rows.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(doc_id, term, pwl, pwr): distinct neighbours over weight, to the left and right."""
    side = lambda term, l, r: F.struct(F.col(term).alias("term"), F.lit(l).alias("l"), (F.col("weight") * l).alias("lw"), F.lit(r).alias("r"), (F.col("weight") * r).alias("rw"))
    ends = edges.select("doc_id", F.inline(F.array(side("b", 1, 0), side("a", 0, 1))))
    sums = ends.groupBy("doc_id", "term").agg(*(F.sum(c).alias(c) for c in ("l", "lw", "r", "rw")))
    ratio = lambda n, w: F.when(F.col(w) > 0, F.col(n) / F.col(w)).otherwise(0.0)
    return sums.select("doc_id", "term", ratio("l", "lw").alias("pwl"), ratio("r", "rw").alias("pwr"))


def _scores(rows: DataFrame) -> DataFrame:
    pwl, pwr = F.coalesce("pwl", F.lit(0.0)), F.coalesce("pwr", F.lit(0.0))
    share = F.col("tf") / F.col("top")
    rel = (0.5 + pwl * share) + (0.5 + pwr * share)
    freq = F.col("tf") / (F.col("mean") + F.col("std"))
    spread = F.col("n_sents") / F.col("all_sents")
    case = F.greatest("tf_a", "tf_n") / (1 + F.log(F.col("tf").cast("double")))
    place = F.log(F.log(3 + F.col("median_sent")))
    under = case + freq / rel + spread / rel
    h = F.when(F.col("mean").isNull() | (under == 0), 0.0).otherwise(place * rel / under)
    return rows.select("doc_id", "term", "tf", "stop", h.alias("h"))


def profiles(documents: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(doc_id, term, tf, tf_a, tf_n, n_sents, median_sent, stop, pwl, pwr, all_sents): ``terms`` and ``degrees`` from one pass.

    A word's form and its neighbours' are told once, within the sentence's row; one aggregation by document and term
    does the rest. Texts are dealt by doc_id once, and no other row moves.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id").select("doc_id", X.sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.size("s").alias("all_sents"), F.posexplode("s").alias("sent", "s")).select("doc_id", "all_sents", "sent", X.tokens(F.col("s")).alias("w"))
    rows = rows.select("doc_id", "all_sents", "sent", "w", F.transform("w", X.is_punctuation).alias("marks"))
    told = lambda t, i: F.when(~F.get("marks", i), F.struct(t.alias("word"), X.tag(t, i - _first()).alias("tag"), X.normalise(t).alias("term")))
    rows = rows.select("doc_id", "all_sents", "sent", F.transform("w", told).alias("w"))
    plain = lambda t: t.isNotNull() & ~t["tag"].isin("u", "d")
    beside = lambda t, o: F.when(plain(t) & plain(o), o["term"])
    near = lambda t, i: F.struct(
        i.alias("at"), t["word"].alias("word"), t["tag"].alias("tag"), t["term"].alias("term"),
        beside(t, F.when(i > 0, F.get("w", i - 1))).alias("left"), beside(t, F.get("w", i + 1)).alias("right"),
    )
    rows = rows.select("doc_id", "all_sents", "sent", F.inline(F.filter(F.transform("w", near), lambda t: t["term"].isNotNull())))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = rows.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), count(F.col("tag") == "a").alias("tf_a"), count(F.col("tag") == "n").alias("tf_n"), F.collect_set("sent").alias("sents"),
        F.min_by(is_stopword(F.col("word"), F.col("term"), stopwords), F.struct("sent", "at")).alias("stop"), F.max("all_sents").alias("all_sents"),
        F.size(F.collect_set("left")).alias("l"), F.count("left").alias("lw"), F.size(F.collect_set("right")).alias("r"), F.count("right").alias("rw"),
    )
    ratio = lambda n, w: F.when(F.col(w) > 0, F.col(n) / F.col(w)).otherwise(0.0)
    return rows.select(
        "doc_id", "term", "tf", "tf_a", "tf_n", F.size("sents").cast("bigint").alias("n_sents"), _median("sents").alias("median_sent"), "stop", ratio("l", "lw").alias("pwl"), ratio("r", "rw").alias("pwr"), "all_sents"
    )


def scored_terms(documents: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(doc_id, term, tf, stop, h)."""
    plain, own = F.when(~F.col("stop"), F.col("tf")), Window.partitionBy("doc_id")
    rows = profiles(documents, stopwords)
    return _scores(rows.withColumn("mean", F.avg(plain).over(own)).withColumn("std", F.stddev_pop(plain).over(own)).withColumn("top", F.max("tf").over(own)))


def phrase_counts(documents: DataFrame) -> DataFrame:
    """(n, key, docs, tf): phrases of one to three words of a block in lower case, the documents where some occurrence has neither numbers nor mixed words, and all occurrences there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in P.slices(batches):
            yield from P.counts(part)

    rows = P.dealt(documents).mapInArrow(run, "n int, key string, docs bigint, tf bigint")
    return rows.groupBy("n", "key").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf"))


def phrase_scores(documents: DataFrame, stopwords: tuple[str, ...] = STOPWORDS, with_denominator: bool = False) -> DataFrame:
    """(doc_id, key, surface, n, tf, s): candidates that neither begin nor end with a stopword; small scores are key phrases.

    A stopword in the middle is bridged by the probabilities of its two edges. Documents without an id have no rows.
    """
    names = ["doc_id", "key", "surface", "n", "tf", "s", *(["under"] if with_denominator else [])]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in P.slices(batches):
            ids = pa.array(part.ids)
            for found in P.scored(part, stopwords):
                runs = found.runs
                columns = [
                    ids.take(pa.array(part.of[runs.last])), part.text(runs, lower=True), part.text(runs, lower=False), pa.array(np.full(len(runs.last), runs.n, np.int32)),
                    pa.array(runs.tf), pa.array(found.s, mask=np.isnan(found.s)), pa.array(found.under),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    schema = f"doc_id {kind}, key string, surface string, n int, tf bigint, s double" + (", under double" if with_denominator else "")
    return P.dealt(documents.where(F.col("doc_id").isNotNull())).mapInArrow(run, schema)


def key_phrases(documents: DataFrame, top: int = 20, dedup: float = 0.9, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(doc_id, rank, phrase, score): the best phrases of each document as first written, without near-copies of better ones, in order of (score, lower case)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in P.slices(batches):
            of, rank, phrase, score = P.best(part, P.scored(part, stopwords), top, dedup)
            columns = [pa.array(part.ids, pa.int64()).take(pa.array(of)), pa.array(rank, pa.int32()), pa.array(phrase, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rank", "phrase", "score"])

    found = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return P.dealt(found).mapInArrow(run, "doc_id bigint, rank int, phrase string, score double").withColumn("score", F.round("score", 12))
