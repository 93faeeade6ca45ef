"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, whatever lines they are on, of ``SPAN`` words, or twice as many as the longest
template has; a window begins every half of that, so as many neighbouring words as a template has are in one block. A template is found in a block
when at least ``LEAST`` of its distinct words are in it. Words are put in a global order, rarest first over all
documents; a block that holds enough of a template must hold a word of its prefix (the first size - needed + 1 words),
so blocks and prefixes are joined on words. Pairs that can't reach the number needed, by the block's length or by
what is left after the first common word's places, are dropped; the rest is verified on the whole sets. A label is
given where a found block also holds the words that name the template. DataFrame functions only; the template tables
are broadcast up to ``SMALL`` rows.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows are scanned each; empty tables give
empty results; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices in common use, with a label each and the words that name what it stands for.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("lgpl", "this library is free software under the terms of the gnu lesser general public license", "gnu lesser"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("cc-by", "this work may be copied under a creative commons attribution licence", "creative commons"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike"),
    ("cc0", "released into the public domain under cc0", "public domain"),
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
)
LEAST = 0.8
SPAN, STEP = 48, 24  # words of a block, and from one block to the next, at least
SMALL = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, lower-case letters and characters beyond ASCII, after lower-casing."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(of: Column, phrase: str) -> Column:
    parts = phrase.split()
    n = F.size(of)
    same = lambda i: F.array_contains(F.array(*(F.get(of, i + k) == p for k, p in enumerate(parts))), False)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - len(parts), F.lit(0))), lambda i: ~same(i))
    return F.when(F.array_contains(of, parts[0]) & (n >= len(parts)), places).otherwise(F.array().cast("array<int>"))


def scan_phrases(text: Column) -> Column:
    """Struct of n_words, n_base, first_word, last_word and the array base of labels."""

    def body(w: Column) -> Column:
        found = F.array(*(_starts(w, p) for p in PHRASES))
        named = F.array(*map(F.lit, PHRASES.values()))

        def summary(lists: Column) -> Column:
            places = F.flatten(lists)
            labels = F.filter(F.zip_with(lists, named, lambda s, label: F.when(F.size(s) > 0, label)), lambda x: x.isNotNull())
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.size(places).cast("bigint").alias("n_base"),
                F.array_min(places).cast("bigint").alias("first_word"),
                F.array_max(places).cast("bigint").alias("last_word"),
                F.array_sort(F.array_distinct(labels)).alias("base"),
            )

        return _let(found, summary)

    return _let(words(text), body)


def _template_tables(documents: DataFrame, templates, least: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """(prefix words with their template and place, templates with their words, words that start a prefix)."""
    spark = documents.sparkSession
    vocabulary = sorted({w for _, *t in templates for part in t for w in part.split()})
    known = F.array(*map(F.lit, vocabulary))
    counts = documents.select(F.explode(F.array_intersect(words(F.col("text")), known)).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # a row for each word of the templates at most
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for i, (label, text, naming) in enumerate(templates):
        ranks = sorted({rank[w] for w in text.split()})
        needed = max(1, math.ceil(least * len(ranks) - 1e-9))
        whole.append((i, label, ranks, sorted({rank[w] for w in naming.split()})))
        prefixes += [(ranks[j], i, j, len(ranks), needed) for j in range(len(ranks) - needed + 1)]
    prefix = spark.createDataFrame(prefixes, "rank int, template int, place int, size int, needed int")
    full = spark.createDataFrame(whole, "template int, label string, ranks array<int>, naming array<int>")
    few = len(prefixes) <= SMALL
    return (F.broadcast(prefix) if few else prefix), (F.broadcast(full) if few else full), order


def spans(templates=TEMPLATES) -> tuple[int, int]:
    """Words of a block, and from one block to the next: both follow the longest template."""
    longest = max((len(text.split()) for _, text, _ in templates), default=0)
    return max(SPAN, 2 * longest), max(STEP, longest)


def similar_blocks(documents: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, block, template, label, containment, named): every block and template that meet the threshold, and whether the naming words are there."""
    prefix, full, order = _template_tables(documents, templates, least)
    starts = {r for r in _prefix_ranks(templates, order, least)}
    rare = F.array(*(F.lit(order[r]) for r in sorted(starts)))
    ranks = F.create_map(*(F.lit(x) for i, w in enumerate(order) for x in (w, i)))
    w = words(F.col("text"))
    held = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), w.alias("w")).where(F.arrays_overlap("w", rare))
    span, step = spans(templates)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.array_distinct(F.slice(F.col("w"), i + 1, F.lit(span))))
    sets = held.select("doc_id", "text_hash", F.posexplode(windows).alias("block", "words"))
    sets = sets.where(F.arrays_overlap("words", rare)).select(
        "doc_id", "text_hash", "block", F.size("words").alias("length"),
        F.array_sort(F.filter(F.transform("words", lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull())).alias("own"),
    )
    marked = sets.select("*", F.posexplode("own").alias("at", "rank"))
    near = marked.join(prefix, "rank").where(
        (F.col("length") >= F.col("needed")) & (1 + F.least(F.size("own") - F.col("at"), F.col("size") - F.col("place")) - 1 >= F.col("needed"))
    )
    near = near.dropDuplicates(["doc_id", "text_hash", "block", "template"]).join(full, "template")
    common = F.size(F.array_intersect("own", "ranks"))
    return near.where(common >= F.col("needed")).select("doc_id", "text_hash", "block", "template", "label", (common / F.col("size")).alias("containment"), (F.size(F.array_intersect("own", "naming")) == F.size("naming")).alias("named"))


def _prefix_ranks(templates, order: list[str], least: float) -> set[int]:
    rank = {w: i for i, w in enumerate(order)}
    found: set[int] = set()
    for _, text, _ in templates:
        ranks = sorted({rank[w] for w in text.split()})
        found.update(ranks[: len(ranks) - max(1, math.ceil(least * len(ranks) - 1e-9)) + 1])
    return found


def scan(documents: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    documents = documents.select("doc_id", "text")
    matched = similar_blocks(documents, templates, least).where("named").groupBy(F.col("doc_id").alias("__id"), "text_hash")
    matched = matched.agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    base = documents.select("doc_id", F.xxhash64("text").alias("__hash"), scan_phrases(F.col("text")).alias("s"))
    out = base.join(matched, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("text_hash")), "left")
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("s.base", F.coalesce("found", empty))))
    return out.select(
        "doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word",
        F.array_join("s.base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("s.n_base") > 0, 1.0).otherwise(0.0), F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
