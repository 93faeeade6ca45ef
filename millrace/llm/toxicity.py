"""Toxicity by the nearest labelled examples: exact TF-IDF cosine with a block-max inverted index.

Terms are all words of a text, hashed (of words over ``LONG`` letters their 5-grams). A term's weight is
(1 + ln occurrences) * idf * relevance: document frequencies are counted over all documents, and relevance, between
``FLOOR`` and 1 + ``FLOOR``, grows with how surely the labelled sample says that the term tells the labels apart. No term is
left out: what the labels don't know still counts with ``FLOOR`` of its idf.

A bounded balanced sample of labelled documents supplies the examples. Their index is broadcast, and every batch of
texts is looked up where it lies: a scan that counts, a scan that scores, no shuffle of texts.

The k nearest examples are exact. Like examples stand in one block. Terms that many examples have are a small matrix,
whose product with a batch of texts gives each cosine's first part. All other terms have inverted lists and keep their
largest weight per block: a block whose bound (its best first part and the query's product with those maxima) is under
the k-th best of the parts known so far is skipped.

Defined cases: null and empty texts, and texts without a letter, have no neighbour and get the score of a vote of 0;
without labels of both kinds every score is 0; ties between examples go to the smaller doc_id; a null id is never
held out; repeated rows are scored each; clashing columns are not read; long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import append_columns, balanced_sample, held_out, labelled, summed_vectors
from millrace.llm.textvec import folded, words

FOLDS, FOLD = 3, 1
LONG, BITS = 16, 20
TRAIN_ROWS = 12_000  # bound of the labelled sample that relevance is counted on
EXAMPLES = 2_000  # bound of the examples in the index
BLOCK = 64
OFTEN = 32  # a term in more than one of so many examples is a row of the matrix
DENSE = 4096  # rows of the matrix at most, those of the most frequent terms: 64 MB with 2,000 examples
BATCH = 512  # texts that are multiplied at once
K = 15
PRIOR = 0.5  # similarity that votes for label 0 beside the neighbours
FLOOR = 0.1  # relevance of a term that tells nothing
SURE = (2.0, 10.0)  # standard deviations between which relevance rises


@dataclass(frozen=True)
class ExampleIndex:
    value: np.ndarray  # idf times relevance, by bucket
    frequent: np.ndarray  # bucket -> row of the matrix or -1
    matrix: np.ndarray  # frequent terms x places of examples
    lookup: np.ndarray  # bucket -> term with an inverted list or -1
    ids: np.ndarray
    labels: np.ndarray
    block_starts: np.ndarray  # postings of term t in block b: block_starts[t, b] : block_starts[t, b + 1]
    examples: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray  # terms x blocks, rounded up
    slope: float = 10.0
    offset: float = -5.0


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, occurrences), by row and bucket."""
    found = [(r.astype(np.int64) << BITS) + b for row, chars in folded(texts) for r, b in [words(row, chars, LONG, BITS)]]
    keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts


def vectors(texts: list[str | None], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (row, bucket, weight)."""
    row, bucket, n = term_counts(texts)
    w = (1.0 + np.log(n)) * value[bucket]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(texts)))
    return row, bucket, w / norm[row]


def relevance(n0: float, n1: float, in0: np.ndarray, in1: np.ndarray) -> np.ndarray:
    """``FLOOR`` and up to 1 more, by how many standard deviations a term's shares of the two labels differ."""
    share = (in0 + in1) / (n0 + n1)
    sure = np.abs(in1 / n1 - in0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return FLOOR + np.clip((np.where(in0 + in1 < 3, 0.0, sure) - SURE[0]) / (SURE[1] - SURE[0]), 0.0, 1.0)


def _alike(example: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """A number for each example, equal for like ones: k-means of a random projection of the vectors."""
    rng = np.random.default_rng(0)
    signs = rng.choice([-1.0, 1.0], (4096, 32))
    x = np.zeros((n, 32))
    np.add.at(x, example, weight[:, None] * signs[bucket % 4096])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    centers = x[:: max(BLOCK, 1)].copy()
    of = np.zeros(n, np.int64)
    for _ in range(rounds):
        of = (x @ centers.T).argmax(axis=1)
        np.add.at(centers, of, x)
        centers /= np.maximum(np.sqrt((centers * centers).sum(axis=1, keepdims=True)), 1e-12)
    return of


def build_index(value, ids, labels, rows) -> ExampleIndex:
    """rows: (example, bucket, weight). Examples with like terms share a block, which makes its maxima tight."""
    example, bucket, weight = rows
    n = len(ids)
    place = np.empty(n, np.int64)
    by = np.lexsort((ids, _alike(example, bucket, weight, n), labels))
    place[by] = np.arange(n)
    example = place[example]
    blocks = -(-n // BLOCK)
    held = np.bincount(bucket, minlength=len(value))
    often = np.flatnonzero(held * OFTEN > n)
    often = np.sort(often[np.argsort(-held[often], kind="stable")[:DENSE]])
    frequent = np.full(len(value), -1, np.int32)
    frequent[often] = np.arange(len(often))
    matrix = np.zeros((len(often), blocks * BLOCK))
    dense = frequent[bucket] >= 0
    matrix[frequent[bucket[dense]], example[dense]] = weight[dense]
    example, bucket, weight = example[~dense], bucket[~dense], weight[~dense]
    known, term = np.unique(bucket, return_inverse=True)
    lookup = np.full(len(value), -1, np.int32)
    lookup[known] = np.arange(len(known))
    order = np.lexsort((example, term))
    example, term, weight = example[order], term[order], weight[order]
    edges = np.arange(len(known))[:, None] * (blocks + 1) + np.arange(blocks + 1)
    block_starts = np.searchsorted(term * (blocks + 1) + example // BLOCK, edges).astype(np.int32)
    block_max = np.zeros((len(known), blocks), np.float32)
    np.maximum.at(block_max, (term, example // BLOCK), np.nextafter(weight.astype(np.float32), np.float32(2)))
    return ExampleIndex(value, frequent, matrix, lookup, ids[by], labels[by], block_starts, example.astype(np.int32), weight, block_max)


def first_parts(index: ExampleIndex, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """rows x places: what the frequent terms give to the cosines."""
    at = index.frequent[bucket]
    query = np.zeros((rows, len(index.matrix)))
    query[row[at >= 0], at[at >= 0]] = weight[at >= 0]
    return query @ index.matrix


def nearest(index: ExampleIndex, bucket: np.ndarray, weight: np.ndarray, k: int, skip: int | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k nearest with a cosine over 0, exactly; ``skip`` leaves out one id. ``part``: the query's first parts."""
    if part is None:
        part = first_parts(index, np.zeros(len(bucket), np.int64), bucket, weight, 1)[0]
    n = len(index.ids)
    score = part.copy()
    wanted = k + int(skip is not None)
    least = np.partition(part, -wanted)[-wanted] if len(part) > wanted else 0.0
    term = index.lookup[bucket]
    term, weight = term[term >= 0], weight[term >= 0]
    if len(term):
        bound = weight @ index.block_max[term] + part.reshape(-1, BLOCK).max(axis=1)
        blocks = np.flatnonzero(bound >= least * (1 - 1e-9))
        whole = 2 * len(blocks) > len(bound)  # then the lists are read from end to end
        lo = (index.block_starts[term, 0] if whole else index.block_starts[term[:, None], blocks].ravel()).astype(np.int64)
        size = (index.block_starts[term, -1] if whole else index.block_starts[term[:, None], blocks + 1].ravel()) - lo
        post = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = np.repeat(weight, size if whole else size.reshape(len(term), -1).sum(axis=1))
        score += np.bincount(index.examples[post], weights=own * index.weights[post], minlength=len(score))
    score = score[:n]
    if skip is not None:
        score[index.ids == skip] = 0.0
    edge = np.partition(score, -k)[-k] if n > k else 0.0
    best = np.flatnonzero((score >= edge) & (score > 0))
    best = best[np.lexsort((index.ids[best], -score[best]))[:k]]
    return best, score[best]


def vote(index: ExampleIndex, best: np.ndarray, cosine: np.ndarray) -> float:
    """Share of label 1 among the neighbours, weighted by cosine."""
    return float((cosine * index.labels[best]).sum() / (cosine.sum() + PRIOR))


def calibrated(votes: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(slope * votes + offset)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps; ``weight``: how much each row counts, 1 by default."""
    weight = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ beta, -30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        step = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(documents: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS, seed: int = 1) -> ExampleIndex | None:
    """Counts terms by label in the sample and over all documents, and indexes the examples."""
    known = balanced_sample(labelled(labels, column, FOLDS, FOLD), rows, seed)
    sample = documents.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # at most about ``rows`` ids

    def by_label(batches):
        out = {k: np.zeros((1 << BITS) + 1) for k in "01"}
        for batch in batches:
            y, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for at in range(0, len(texts), 2048):
                row, bucket, _ = term_counts(texts[at : at + 2048])
                for k in (0, 1):
                    out[str(k)][:-1] += np.bincount(bucket[y[at + row] == k], minlength=1 << BITS)
            for k in (0, 1):
                out[str(k)][-1] += (y == k).sum()
        return out

    sums = summed_vectors(sample, ["y", "text"], by_label, (1 << BITS) + 1)
    if len(sums) < 2:
        return None
    in0, in1 = sums["0"], sums["1"]

    def frequencies(batches):
        total = np.zeros((1 << BITS) + 1)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 2048):
                total[:-1] += np.bincount(term_counts(texts.slice(at, 2048).to_pylist())[1], minlength=1 << BITS)
            total[-1] += len(texts)
        return {"df": total}

    df = summed_vectors(documents, ["text"], frequencies, (1 << BITS) + 1)["df"]
    value = (np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0) * relevance(in0[-1], in1[-1], in0[:-1], in1[:-1])
    index_rows = balanced_sample(known, EXAMPLES, seed + 1)
    shared = documents.sparkSession.sparkContext.broadcast(value)
    fields = [T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]

    def as_lists(texts):
        row, bucket, weight = vectors(texts, shared.value)
        cut = np.searchsorted(row, np.arange(1, len(texts)))
        return [np.split(bucket, cut), np.split(weight, cut)]

    examples = append_columns(documents.join(F.broadcast(index_rows), "doc_id"), "text", fields, as_lists, keep=["doc_id", "y"])
    got = examples.toArrow().sort_by("doc_id")  # bounded by EXAMPLES
    ids, y = got.column("doc_id").to_numpy().astype(np.int64), got.column("y").to_numpy().astype(np.float64)
    terms, weights = ([np.asarray(x.values) for x in got.column(c)] for c in ("terms", "weights"))
    rows_ = np.repeat(np.arange(len(ids)), [len(t) for t in terms]), np.concatenate(terms).astype(np.int64), np.concatenate(weights)
    index = build_index(value, ids, y, rows_)
    votes = np.array([vote(index, *nearest(index, t, w, K, skip=i)) for i, t, w in zip(ids, terms, weights, strict=True)])
    slope, offset = fit_logistic(votes, y) if 0 < y.sum() < len(y) else (10.0, -5.0)
    return replace(index, slope=max(slope, 0.0), offset=offset)


def score_texts(index: ExampleIndex, texts: list[str | None]) -> list:
    """[scores, ids of the nearest examples, their cosines] of a batch of texts."""
    row, bucket, weight = vectors(texts, index.value)
    votes = np.zeros(len(texts))
    ids: list[list[int]] = [[] for _ in texts]
    cosines: list[list[float]] = [[] for _ in texts]
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    for from_ in range(0, len(texts), BATCH):
        to = min(from_ + BATCH, len(texts))
        here = slice(cut[from_], cut[to])
        parts = first_parts(index, row[here] - from_, bucket[here], weight[here], to - from_)
        for i in range(from_, to):
            at = slice(cut[i], cut[i + 1])
            if cut[i] < cut[i + 1]:
                best, cosine = nearest(index, bucket[at], weight[at], K, part=parts[i - from_])
                votes[i] = vote(index, best, cosine)
                ids[i], cosines[i] = index.ids[best[:5]].tolist(), cosine[:5].tolist()
    return [calibrated(votes, index.slope, index.offset), ids, cosines]


def score(documents: DataFrame, index: ExampleIndex | None) -> DataFrame:
    """(doc_id, score, evidence_ids, evidence_cosines) of every document."""
    if index is None:
        none = F.array().cast("array<bigint>"), F.array().cast("array<double>")
        return documents.select("doc_id", F.lit(0.0).alias("score"), none[0].alias("evidence_ids"), none[1].alias("evidence_cosines"))
    shared = documents.sparkSession.sparkContext.broadcast(index)
    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence_ids", T.ArrayType(T.LongType())),
        T.StructField("evidence_cosines", T.ArrayType(T.DoubleType())),
    ]
    return append_columns(documents, "text", fields, lambda texts: score_texts(shared.value, texts), keep=["doc_id"])


def classify(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence...) of every document."""
    out = score(documents, train(documents, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
        "evidence_ids",
        "evidence_cosines",
    )
