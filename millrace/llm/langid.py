"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages) is broadcast; every batch of texts is scored as a sparse product
with it, so the work is one scan without a shuffle. The number of buckets is fixed. Beyond ``TOGETHER`` languages the
matrix is cut by languages, and a scan for each part carries the best language and the sum of the likelihoods on. Documents are counted by
language over all data: the counts give the priors, and the sample that is learned from takes rare languages whole
and as many documents of each frequent one as its bound leaves.

Defined cases: a null text and a text without a letter give ``und`` with score 0; with nothing to learn
from every text gives ``und``; a null id is never held out; repeated rows are scored each; a column that
is already called like a result is replaced; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, append_columns, held_out, summed_vectors
from millrace.llm.textvec import folded, grams

UNKNOWN = "und"
ORDERS = (1, 2, 3)
FOLDS, FOLD = 3, 1
TRAIN_ROWS = 20_000  # bound of the sample that is learned from
LEAST_ROWS = 16  # of each language that has them, also where TRAIN_ROWS would leave fewer
BITS = 16
TOGETHER = 256  # languages of one broadcast matrix, of 64 MB


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages, float32
    log_prior: np.ndarray

    def part(self, languages: slice) -> "LanguageModel":
        return LanguageModel(self.languages[languages], np.ascontiguousarray(self.log_prob[:, languages]), self.log_prior[languages])


def quota(counts: list[int], rows: int) -> int:
    """The most documents of one language for which a sample holds at most ``rows`` in all, or ``LEAST_ROWS``."""
    left, of = rows, len(counts)
    for n in sorted(counts):
        if n * of > left:
            return max(left // of, LEAST_ROWS)
        left, of = left - n, of - 1
    return max([*counts, LEAST_ROWS])


def sample_by_language(known: DataFrame, counts: dict[str, int], rows: int, seed: int) -> DataFrame:
    """About ``quota`` documents of each language at most, the same on every run: a hash of the id decides."""
    most = quota(list(counts.values()), rows)
    space = 1 << 30
    limits = [(k, space if n <= most else int(space * most / n)) for k, n in counts.items()]
    limits = known.sparkSession.createDataFrame(limits, "lang string, below bigint")
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(space)) < F.col("below")
    return known.join(F.broadcast(limits), "lang").where(chosen).select(*known.columns)


def train(documents: DataFrame, rows: int = TRAIN_ROWS, smoothing: float = 0.5, seed: int = 8) -> LanguageModel:
    """Learns from text and lang of at most about ``rows`` documents outside the held-out fold, or ``LEAST_ROWS`` of each language."""
    known = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)
    ).select("doc_id", "lang", "text")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known_counts = {r["lang"]: r["n"] for r in counted.collect()}  # a row for each language
    languages = tuple(sorted(known_counts))
    sample = sample_by_language(known, known_counts, rows, seed)

    def count(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            index = {k: i for i, k in enumerate(dict.fromkeys(langs))}
            of = np.array([index[k] for k in langs], np.int64)
            counts = np.zeros((len(index), 1 << BITS))
            for row, chars in folded(texts):
                for n in ORDERS:
                    r, b = grams(row, chars, n, BITS)
                    counts += np.bincount((of[r] << BITS) + b, minlength=counts.size).reshape(counts.shape)
            for k, i in index.items():
                out[k] = out[k] + counts[i] if k in out else counts[i]
        return out

    sums = summed_vectors(sample, ["lang", "text"], count, 1 << BITS) if languages else {}
    languages = tuple(k for k in languages if k in sums)
    counts = np.array([sums[k] for k in languages]).reshape(len(languages), 1 << BITS) + smoothing
    docs = np.array([known_counts[k] for k in languages]) + 1.0
    log_prob = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return LanguageModel(languages, np.ascontiguousarray(log_prob.T, dtype=np.float32), np.log(docs / max(docs.sum(), 1)))


def log_likelihoods(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages, which texts have a letter)."""
    n, k = len(texts), len(model.languages)
    total = np.tile(model.log_prior, (n, 1))
    letters = np.zeros(n, bool)
    for row, chars in folded(texts):
        letters[row[chars != 32]] = True
        low, high = int(row[0]), int(row[-1]) + 1
        for order in ORDERS:
            r, b = grams(row, chars, order, BITS)
            values = model.log_prob[b]
            for j in range(k):
                total[low:high, j] += np.bincount(r - low, weights=values[:, j], minlength=high - low)
    return total, letters


def score_texts(model: LanguageModel, texts: list[str | None]) -> list:
    """[languages, log-likelihoods of them, and of all languages] of a batch of texts; ``und`` for those without a letter."""
    n = len(texts)
    if not model.languages:
        return [[UNKNOWN] * n, np.zeros(n), np.zeros(n)]
    total, letters = log_likelihoods(model, texts)
    best, top = total.argmax(axis=1), total.max(axis=1)
    names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
    return [names, top, top + np.log(np.exp(total - top[:, None]).sum(axis=1))]


_TOLD = [T.StructField("__name", T.StringType()), T.StructField("__top", T.DoubleType()), T.StructField("__all", T.DoubleType())]


def predict(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, the posterior probability."""
    spark = documents.sparkSession
    columns = [c for c in (keep or documents.columns) if c not in ("lang_pred", "score")]
    cuts = [slice(a, a + TOGETHER) for a in range(0, max(len(model.languages), 1), TOGETHER)]
    out, scratch = documents.withColumn("__words", F.col("text")), Scratch(spark)
    for i, cut in enumerate(cuts):
        shared = spark.sparkContext.broadcast(model.part(cut))
        before = [F.col(f.name).alias(f"__old{f.name}") for f in _TOLD] if i else []
        kept = [*columns, *(["__words"] if i + 1 < len(cuts) else []), *(f"__old{f.name}" for f in _TOLD if i)]
        source = out.select("*", *before) if i else out
        out = append_columns(source, "__words", _TOLD, lambda texts, shared=shared: score_texts(shared.value, texts), kept)
        if i:
            better = F.col("__top") > F.col("__old__top")
            high, low = F.greatest("__all", "__old__all"), F.least("__all", "__old__all")
            merged = [F.when(better, F.col("__name")).otherwise(F.col("__old__name")), F.greatest("__top", "__old__top"), high + F.log1p(F.exp(low - high))]
            out = out.select(*[c for c in kept if not c.startswith("__old")], *(m.alias(f.name) for m, f in zip(merged, _TOLD, strict=True)))
        if i + 1 < len(cuts):
            out = scratch.save(out, f"languages{i}")
    score = F.when(F.col("__name") == UNKNOWN, 0.0).otherwise(F.exp(F.col("__top") - F.col("__all")))
    return out.select(*columns, F.col("__name").alias("lang_pred"), score.alias("score"))


def identify(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of those outside the held-out fold."""
    out = predict(documents, train(documents, **options), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")


def accept(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a posterior of ``least`` or more, columns as they are."""
    known = documents.select("doc_id", "lang", "text")
    scored = predict(documents.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), train(known))
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*documents.columns)
