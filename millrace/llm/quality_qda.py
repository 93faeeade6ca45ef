"""Quality score: regularised quadratic discriminant analysis over transformed document statistics.

Per class a mean and a covariance that is shrunk towards the pooled one and towards its diagonal; the score
comes from the difference of the Mahalanobis log-densities, computed with cached Cholesky factors, through a
logistic curve fitted on the training rows. One scan with a broadcast model of a few kilobytes, no shuffle.

Defined cases: null and empty texts have zero statistics and are scored as such; without labels of both kinds
every score is 0.5; a null id is never held out; repeated rows are scored each; clashing columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import append_columns, held_out, labelled, text_slices, weighted_sample
from millrace.llm.textvec import code_points
from millrace.llm.toxicity import fit_logistic

FOLDS, FOLD = 4, 2
TRAIN_ROWS = 12_000  # bound of the labelled sample
SLICE = 1 << 18
LONGEST = 1 << 22  # longer texts are read piece by piece, with the same result
STATISTICS = (
    "log_words", "mean_word", "upper", "digit", "symbol", "bar", "exclaim", "stop", "comma",
    "line_words", "same_as_previous", "distinct_words", "upper_words", "long_words", "distinct_lines",
)
_CLASS: list[np.ndarray] = []
_ODD = (np.random.default_rng(7).integers(1 << 62, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def class_table() -> np.ndarray:
    """Classes of code points: 0 other, 1 upper, 2 lower or uncased letter, 3 digit, 4 space, 5 newline, 6 symbol, 7 bar, 8 !, 9 stop, 10 comma."""
    if not _CLASS:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x30000):
            c = chr(i)
            t[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
        for k, chars in ((5, "\n"), (6, "#*$%&<>{}[]=+~^\\@_"), (7, "|"), (8, "!?"), (9, "."), (10, ",;:")):
            for c in chars:
                t[ord(c)] = k
        _CLASS.append(t)
    return _CLASS[0]


def _groups(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values for each key in 0..n-1."""
    order = np.lexsort((values, keys))
    k, v = keys[order], values[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    return np.bincount(k[new], minlength=n)


def _hashes(chars: np.ndarray, starts: np.ndarray, inside: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One hash for each run: the sum of its characters times odd numbers by position."""
    value = _mixed(chars, np.arange(len(chars)) - starts[owner])
    value[~inside] = 0
    return np.add.reduceat(value, starts)


def _mixed(chars: np.ndarray, place: np.ndarray) -> np.ndarray:
    value = (chars.astype(np.uint64) + np.uint64(1)) * _ODD[place & 63] * (place.astype(np.uint64) // np.uint64(64) + np.uint64(1))
    return value ^ (value >> np.uint64(31))


def _long_sums(text: str, longest: int) -> np.ndarray:
    """The sums of one text, piece by piece: words and lines go on over the cuts, the sets of their hashes are kept."""
    table = class_table()
    out, by = np.zeros(16), np.zeros(11)
    none = np.zeros(0, np.uint64)
    seen_words, seen_lines, previous = none, none, none
    word, size, ups = none, 0, 0  # of the word that goes on: hash, characters, upper ones
    line, held = none, 0  # of the line that goes on: hash, words
    for at in range(0, len(text) + 1, longest):
        chars = code_points(text[at : at + longest] + ("\n" if at + longest > len(text) else ""))
        kind = table[chars]
        by += np.bincount(kind, minlength=11)
        gap = (kind == 4) | (kind == 5)
        fresh = np.flatnonzero(~gap & np.concatenate([[not size], gap[:-1]]))
        starts = np.concatenate([[0], fresh])  # what comes before the first fresh word ends the one that goes on
        owner = np.searchsorted(starts, np.arange(len(chars)), side="right") - 1
        place = np.arange(len(chars)) - starts[owner]
        place[owner == 0] += size
        value = _mixed(chars, place)
        value[gap] = 0
        ended = value[: fresh[0]] if len(fresh) else value
        hashes = np.append(np.concatenate([word, ended]).sum(dtype=np.uint64, keepdims=True), np.add.reduceat(value, fresh) if len(fresh) else none)
        sizes = np.bincount(owner[~gap], minlength=len(starts))
        uppers = np.bincount(owner[kind == 1], minlength=len(starts))
        sizes[0] += size
        uppers[0] += ups
        lines = np.concatenate([[0], np.cumsum(kind == 5)[fresh]])
        if not sizes[0]:
            hashes, sizes, uppers, lines = hashes[1:], sizes[1:], uppers[1:], lines[1:]
        word, size, ups = none, 0, 0
        if not gap[-1]:  # the last word goes on
            word, size, ups = hashes[-1:], int(sizes[-1]), int(uppers[-1])
            hashes, sizes, uppers, lines = hashes[:-1], sizes[:-1], uppers[:-1], lines[:-1]
        chain = np.concatenate([previous, hashes])
        previous = chain[-1:]
        out[10] += len(hashes)
        out[11] += (chain[1:] == chain[:-1]).sum()
        out[13] += ((uppers == sizes) & (sizes > 1)).sum()
        out[14] += (sizes > 12).sum()
        seen_words = np.union1d(seen_words, hashes)
        ends = int((kind == 5).sum())  # the number of the line that goes on
        of, first, count = np.unique(lines, return_index=True, return_counts=True)
        if len(of):
            index = np.arange(len(lines)) - np.repeat(first, count)
            index[lines == 0] += held
            sums = np.add.reduceat(hashes * (index.astype(np.uint64) + np.uint64(3)), first)
        else:
            sums = none
        if held and not (len(of) and of[0] == 0):
            of, sums, count = np.append(0, of), np.append(line, sums), np.append(held, count)
        elif held:
            sums[:1] += line
            count[0] += held
        line, held = none, 0
        if len(of) and of[-1] == ends:
            line, held, sums = sums[-1:], int(count[-1]), sums[:-1]
        seen_lines = np.union1d(seen_lines, sums)
    out[0] = by.sum() - by[4] - by[5]
    out[1:10] = by[[1, 2, 3, 6, 7, 8, 9, 10, 5]]
    out[9] -= 1
    out[12], out[15] = len(seen_words), len(seen_lines)
    return out


def statistics(texts: list[str | None], longest: int = LONGEST) -> np.ndarray:
    """rows x STATISTICS. Texts over ``longest`` characters are read piece by piece, with the same result."""
    n = len(texts)
    sums = np.zeros((n, 16))
    for row, text in enumerate(texts):
        if len(text or "") > longest:
            sums[row] = _long_sums(text, longest)
    rows_all = [row for row, text in enumerate(texts) if len(text or "") <= longest]
    strings = [texts[row] or "" for row in rows_all]
    table = class_table()
    for a, b in text_slices(strings, SLICE):
        chars = code_points("".join(f"{p}\n" for p in strings[a:b]))
        lengths = np.fromiter((len(p) + 1 for p in strings[a:b]), np.int64, b - a)
        rows = np.asarray(rows_all[a:b])
        k = b - a
        doc = np.repeat(np.arange(k), lengths)
        kind = table[chars]
        by = np.bincount(doc * 11 + kind, minlength=k * 11).reshape(k, 11).astype(float)
        gap = (kind == 4) | (kind == 5)
        begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        part = np.zeros((k, 16))
        part[:, 0] = by.sum(axis=1) - by[:, 4] - by[:, 5]  # characters in words
        part[:, 1:10] = by[:, [1, 2, 3, 6, 7, 8, 9, 10, 5]]
        part[:, 9] -= 1
        if len(begins):
            starts = np.concatenate([[0], begins])
            owner = np.searchsorted(starts, np.arange(len(chars)), side="right") - 1
            word_hash = _hashes(chars, starts, ~gap, owner)[1:]
            size = np.bincount(owner[~gap], minlength=len(starts))[1:]
            ups = np.bincount(owner[kind == 1], minlength=len(starts))[1:]
            of = doc[begins]
            part[:, 10] = np.bincount(of, minlength=k)
            same = (word_hash[1:] == word_hash[:-1]) & (of[1:] == of[:-1])
            part[:, 11] = np.bincount(of[1:][same], minlength=k)
            part[:, 12] = _groups(of, word_hash, k)
            part[:, 13] = np.bincount(of[(ups == size) & (size > 1)], minlength=k)
            part[:, 14] = np.bincount(of[size > 12], minlength=k)
            line = np.cumsum(kind == 5)[begins]
            line_of, first = np.unique(line, return_index=True)
            line_hash = np.add.reduceat(word_hash * (np.arange(len(word_hash)).astype(np.uint64) - np.repeat(first, np.diff(np.append(first, len(line)))).astype(np.uint64) + np.uint64(3)), first)
            part[:, 15] = _groups(of[first], line_hash, k)
        np.add.at(sums, rows, part)
    words = np.maximum(sums[:, 10], 1)
    chars = np.maximum(sums[:, 0], 1)
    lines = sums[:, 9] + 1
    share = lambda x: np.sqrt(np.clip(x, 0, None))  # noqa: E731  shares are skewed
    return np.column_stack(
        [
            np.log1p(sums[:, 10]), np.log1p(sums[:, 0] / words), share(sums[:, 1] / chars), share(sums[:, 3] / chars),
            share(sums[:, 4] / chars), share(sums[:, 5] / words), share(sums[:, 6] / words), share(sums[:, 7] / words),
            share(sums[:, 8] / words), np.log1p(sums[:, 10] / lines), share(sums[:, 11] / words),
            np.log1p(sums[:, 12]) - np.log1p(sums[:, 10]), share(sums[:, 13] / words), share(sums[:, 14] / words),
            share(1 - np.minimum(sums[:, 15] / lines, 1)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centers: np.ndarray  # class x statistic
    inverse_factors: np.ndarray  # inverses of the lower Cholesky factors, by class
    constants: np.ndarray  # log prior minus half the log determinant
    slope: float
    offset: float


def log_ratio(model: Discriminant, x: np.ndarray) -> np.ndarray:
    """Log-density of class 1 minus that of class 0, tempered by a signed logarithm for calibration."""
    z = (x - model.mean) / model.scale
    density = []
    for c in (0, 1):
        y = (z - model.centers[c]) @ model.inverse_factors[c].T
        density.append(model.constants[c] - 0.5 * (y * y).sum(axis=1))
    d = density[1] - density[0]
    return np.sign(d) * np.log1p(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, diagonal: float = 0.1, weight: np.ndarray | None = None) -> Discriminant | None:
    """Class covariances: (1 - shrink) own + shrink pooled, then ``diagonal`` of the way to the diagonal plus a floor. ``weight`` sets priors and calibration."""
    weight = np.ones(len(x)) if weight is None else weight
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    centers = np.array([z[y == c].mean(axis=0) for c in (0, 1)])
    own = [np.cov(z[y == c].T) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / sum(n)
    inverse, constants = [], []
    for c in (0, 1):
        s = (1 - shrink) * own[c] + shrink * pooled
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        constants.append(np.log(weight[y == c].sum() / weight.sum()) - np.log(np.diag(factor)).sum())
    model = Discriminant(mean, scale, centers, np.array(inverse), np.array(constants), 1.0, 0.0)
    slope, offset = fit_logistic(log_ratio(model, x), y, weight=weight)
    return Discriminant(mean, scale, centers, model.inverse_factors, model.constants, max(slope, 0.0), offset)


_FIELD = [T.StructField("stats", T.ArrayType(T.DoubleType()))]


def train(documents: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS, seed: int = 4) -> Discriminant | None:
    known = weighted_sample(labelled(labels, column, FOLDS, FOLD), rows, seed)
    sample = documents.join(F.broadcast(known), "doc_id")  # at most about ``rows`` ids
    got = append_columns(sample, "text", _FIELD, lambda texts: [list(statistics(texts))], keep=["doc_id", "y", "weight"]).orderBy("doc_id").collect()
    if not got:
        return None
    return fit(*(np.array([r[c] for r in got]) for c in ("stats", "y")), weight=np.array([r["weight"] for r in got]))


def classify(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(documents, labels)
    if model is None:
        out = documents.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = documents.sparkSession.sparkContext.broadcast(model)

        def score(texts):
            m = shared.value
            with np.errstate(over="ignore"):
                return [1.0 / (1.0 + np.exp(-(m.slope * log_ratio(m, statistics(texts)) + m.offset)))]

        out = append_columns(documents, "text", [T.StructField("score", T.DoubleType())], score, keep=["doc_id"])
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
