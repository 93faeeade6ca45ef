"""Quality rules: document statistics and a decision list learned from labelled ones.

Sequential covering: a rule starts empty and takes, one at a time, the threshold condition with the largest gain in
telling low-quality documents from others; it is pruned on rows that it was not grown on and kept if it stays
precise; what it covers is put aside. The list becomes one ordered Spark conditional expression. Everything is
DataFrame functions; only counts by feature and threshold (FEATURES x BINS rows) reach the driver.

Defined cases: null text has no words and fails the base rules; without labels of both kinds the list is empty and
keeps whatever the base rules keep; repeated rows are judged each; empty tables give empty results; a null doc_id
stays null; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, weighted_sample

SPACE = "[\\x20\\x09-\\x0D]"
TRAIN_ROWS = 12_000  # bound of the labelled sample
BINS = 32
CONDITIONS = 3  # of a rule at most, so that it can be read
PRECISE = 0.95  # share of low quality among what a rule covers, on rows that it was not grown on
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Number of words in windows of three words that are found twice or more; ``hashes``: of the windows, in order."""

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        steps = F.transform(F.sequence(F.lit(1), last), lambda j: F.least(F.lit(3), places[j] - places[j - 1]))
        return F.when(last < 0, 0).when(last == 0, 3).otherwise(F.aggregate(steps, F.lit(3), lambda a, s: a + s))

    def twice(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        n = F.size(ordered)
        kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
        return _let(F.sort_array(F.transform(kept, lambda i: F.get(ordered, i)["i"])), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, twice))


def base_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def body(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.when(F.size(w) < 3, 0).otherwise(_let(windows, _repeated)).cast("bigint").alias("n_repeat_words"),
        )

    counted = _let(F.array_remove(F.split(text, f"{SPACE}+"), ""), body)
    duplicates = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return _let(
        counted,
        lambda c: F.struct(c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), symbols.cast("bigint").alias("n_symbols"), duplicates.cast("bigint").alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words")),
    )


def with_statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the base statistics and the features that rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.select(
        *keep,
        base_statistics(F.col("text")).alias("s"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).alias("uppers"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("exclaims"),
        (F.size(F.split(text, "\n"))).alias("lines"),
    )
    df = df.select(*keep, "s.*", "uppers", "exclaims", "lines")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / F.col("lines")).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("uppers") / chars).alias("upper_share"),
        (F.col("exclaims") / words).alias("exclaim_share"),
    )


LOW, OTHER = "low * weight", "(1 - low) * weight"  # what a row counts for either label


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


def _all(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in conditions), F.lit(True))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """Numbers of low and other rows by feature and bin: bin b lies over b of the feature's thresholds."""
    marks = [
        F.struct(F.lit(f).alias("feature"), reduce(lambda a, b: a + b, (F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("bin"))
        for f in FEATURES if cuts[f]
    ]
    long = rows.select("low", "weight", F.explode(F.array(*marks)).alias("m")).groupBy("m.feature", "m.bin")
    return {(r["feature"], r["bin"]): (r["low"], r["n"] - r["low"]) for r in long.agg(F.sum(F.expr(LOW)).alias("low"), F.sum("weight").alias("n")).collect()}


def _best(rows: DataFrame, cuts: dict[str, list[float]], low: int, other: int) -> tuple[float, Condition | None, int, int]:
    """The condition with the largest information gain on covered low rows."""
    counts = _counts(rows, cuts)
    best: tuple[float, Condition | None, int, int] = (0.0, None, low, other)
    before = math.log2((low + 1) / (low + other + 2))
    for f in FEATURES:
        p = n = 0
        for b, cut in enumerate(cuts[f]):
            p, n = p + counts.get((f, b), (0, 0))[0], n + counts.get((f, b), (0, 0))[1]
            for above, (a, c) in ((False, (p, n)), (True, (low - p, other - n))):
                gain = a * (math.log2((a + 1) / (a + c + 2)) - before)
                if gain > best[0] + 1e-9:
                    best = gain, Condition(f, above, cut), a, c
    return best


def learn(documents: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS, conditions: int = CONDITIONS, seed: int = 3) -> list[list[Condition]]:
    """An ordered list of rules that tell low quality, conjunctions of at most ``conditions``, from about ``rows`` labelled documents at most.

    The list ends where the next rule isn't precise, or covers fewer than three rows that it was not grown on.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("y"))
    sample = documents.join(F.broadcast(weighted_sample(known, rows, seed)), "doc_id")
    scratch = Scratch(documents.sparkSession)
    told = with_statistics(sample, "doc_id", "y", "weight").select("doc_id", (1 - F.col("y")).alias("low"), "weight", *FEATURES)
    told = scratch.save(scratch.save(told, "statistics").coalesce(1), "sample")  # bounded by ``rows``
    first = told.agg(F.count(F.lit(1)), F.sum("low"), *(F.percentile_approx(f, [(i + 0.5) / BINS for i in range(BINS)], 1000) for f in FEATURES)).first()
    if not first[0] or not first[1] or first[0] == first[1]:
        return []
    cuts = {f: sorted(set(first[2 + i])) for i, f in enumerate(FEATURES)}
    told = told.withColumn("grown", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) < 2).coalesce(1)
    rules: list[list[Condition]] = []
    while True:
        left = told.where(~reduce(lambda a, b: a | b, (_all(r) for r in rules), F.lit(False)))
        grow = left.where("grown")
        low, other = grow.agg(F.coalesce(F.sum(F.expr(LOW)), F.lit(0)), F.coalesce(F.sum(F.expr(OTHER)), F.lit(0))).first()
        rule: list[Condition] = []
        while len(rule) < conditions and other and low:
            gain, condition, low, other = _best(grow.where(_all(rule)), cuts, low, other)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        held = left.where(~F.col("grown")).agg(*(F.coalesce(F.sum(F.when(_all(rule[:k]), F.expr(x))), F.lit(0)) for k in range(1, len(rule) + 1) for x in (LOW, OTHER))).first()
        worth = [((held[2 * k] - held[2 * k + 1]) / max(held[2 * k] + held[2 * k + 1], 1), -k) for k in range(len(rule))]
        k = -max(worth)[1]
        if held[2 * k] < 3 or held[2 * k] < PRECISE * (held[2 * k] + held[2 * k + 1]):
            break
        rules.append(rule[: k + 1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that tells low quality, from 1; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(_all(rule), F.lit(i + 1))
    return out


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of every document."""
    rules = learn(documents, labels)
    df = with_statistics(documents, "doc_id").withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed())
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
