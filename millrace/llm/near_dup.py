"""Near-duplicate documents: ProbMinHash signatures of weighted five-word shingles, banding, exact verification.

1. One scan: signature bands and an order-free fingerprint of the shingles with their counts.
2. Copies (equal fingerprints) become one representative, the one with the smallest doc_id.
3. The smallest representative of those that share a band is the band's head. Each representative is verified
   against the head that it shares most bands with: one pair each. Components of these links are clusters.
4. A band whose documents are all in one cluster is settled. In any other one, documents of different clusters are
   verified against each other, within the band only, in blocks: those outside the band's largest cluster against
   all others. Signatures are compared as arrays; where they agree in ``LOOK`` of the slots, the exact probability
   Jaccard similarity decides. What comes back is a spanning set of the links of two blocks.
5. Components of all verified links are the classes.

Two documents are linked at a probability Jaccard similarity of ``LEAST`` or more. A pair at 0.8 shares a band
with probability 0.9999 and passes ``LOOK`` with 0.99997.

Defined cases: documents without words (null, empty, white space) and null ids are in no class but their own
(class_id = doc_id); texts of one to four words have one shingle; repeated rows get the same class; a doc_id with
different texts is in the smallest class of its texts, and ``first_of_each`` decides on each of its texts; empty
tables give empty results; other columns are carried along by ``first_of_each`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, append_columns
from millrace.llm.graph import components
from millrace.llm.shingles import SLOTS, mix, probability_jaccard, signatures, slices, weighted_shingles

LEAST = 0.8
LOOK = 0.65
BAND = 5
BANDS = SLOTS // BAND
BLOCK = 2048  # documents, at most about so many, that are verified against as many others in one group
BLOCK_SHINGLES = 1 << 20  # and the shingles of them


def _prints(r: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, two fingerprints) of each of ``n`` texts."""
    count = np.bincount(r, minlength=n)
    code = mix(h * np.uint64(0xD6E8FEB86659FD93) + w.astype(np.uint64))
    edge = np.append(0, np.cumsum(count))
    sums = [np.append(np.zeros(1, np.uint64), np.cumsum(c)) for c in (code, mix(code ^ h))]
    return count, *((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)


def fingerprints(texts: list[str | None]) -> list[np.ndarray]:
    """Two numbers for each text that are equal for texts with equal shingles and counts."""
    found = [_prints(*weighted_shingles(row, word, b - a), b - a)[1:] for a, b, row, word in slices(texts)]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            for a, b, row, word in slices(part.column(1).to_pylist()):
                r, h, w = weighted_shingles(row, word, b - a)
                count, *prints = _prints(r, h, w, b - a)
                some = np.flatnonzero(count)
                index = np.cumsum(count > 0) - 1
                signature = signatures(index[r], h, w.astype(float), len(some))
                bands = np.zeros((len(some), BANDS), np.uint64)
                for k in range(BAND):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::BAND] + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(a, b - a).take(pa.array(some)),
                        *(pa.array(p[some], pa.int64()) for p in (*prints, count)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "p1", "p2", "size", "bands"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and weights of (node, p1, p2, text); texts with other fingerprints are not the node's."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            for a, b, row, word in slices(part.column(3).to_pylist()):
                r, h, w = weighted_shingles(row, word, b - a)
                _, p1, p2 = _prints(r, h, w, b - a)
                edge = np.searchsorted(r, np.arange(b - a + 1))
                right = np.flatnonzero((p1 == part.column(1).slice(a, b - a).to_numpy()) & (p2 == part.column(2).slice(a, b - a).to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(a, b - a).take(pa.array(right)),
                        pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in right], pa.binary()),
                        pa.array([w[edge[i] : edge[i + 1]].astype(np.uint32).tobytes() for i in right], pa.binary()),
                    ],
                    names=["node", "shingles", "weights"],
                )


def _read(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs = zip(group.column("shingles").to_pylist(), group.column("weights").to_pylist(), strict=True)
    return [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.uint32)) for h, w in pairs]


def _as_links(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _to_head(group: pa.Table) -> pa.Table:
    """Links of documents (side 0) with their head (side 1)."""
    nodes, side, sets = group.column("node").to_pylist(), group.column("side").to_pylist(), _read(group)
    heads = [i for i, s in enumerate(side) if s]
    return _as_links([(nodes[i], nodes[j]) for i, s in enumerate(side) if not s for j in heads[:1] if probability_jaccard(sets[i], sets[j]) >= LEAST])


def _links(group: pa.Table) -> pa.Table:
    """A spanning set of the links between clusters in two blocks of a band (or in one with itself)."""
    group = group.sort_by([("node", "ascending"), ("side", "ascending")])
    nodes, side, sets = group.column("node").to_numpy(), group.column("side").to_numpy(), _read(group)
    _, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
    size = np.array([len(s[0]) for s in sets])
    signature = np.concatenate(
        [
            signatures(
                np.repeat(np.arange(len(part)), size[at : at + 256]), np.concatenate([s[0] for s in part]), np.concatenate([s[1] for s in part]).astype(float), len(part)
            ).astype(np.uint32)
            for at in range(0, len(nodes), 256)
            for part in [sets[at : at + 256]]
        ]
    )
    out = []
    own = bool((side == side[0]).all())
    for i in range(len(nodes) - 1):
        others = np.arange(i + 1, len(nodes)) if own else np.flatnonzero(side != side[i])
        others = others[(others > i) & (label[others] != label[i])]
        if not len(others):
            continue
        agree = (signature[others] == signature[i]).mean(axis=1)
        order = np.argsort(-agree, kind="stable")
        for j, a in zip(others[order], agree[order], strict=True):
            if a < LOOK:
                break
            if label[j] != label[i] and probability_jaccard(sets[i], sets[j]) >= LEAST:
                label[label == label[j]] = label[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return _as_links(out)


def _blocks(n, shingles):
    """Number of blocks for so many documents with so many shingles."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _part(blocks):
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _head_links(banded: DataFrame, sets: DataFrame, heads: DataFrame) -> DataFrame:
    """Verified links of representatives with the head that they share most bands with."""
    pairs = banded.join(heads, ["band", "value"]).where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    best = pairs.groupBy("node").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"), F.first("size").alias("size"))
    blocks = best.groupBy("head").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    members = best.select("node", "head").join(blocks, "head").select("head", _part(F.col("blocks")).alias("part"), F.lit(0).alias("side"), "node")
    own = blocks.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("side"), F.col("head").alias("node"))
    return members.unionByName(own).join(sets, "node").groupBy("head", "part").applyInArrow(_to_head, "a bigint, b bigint")


def _band_links(banded: DataFrame, sets: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links between clusters within bands; of bands with the same documents one is enough."""
    label = F.coalesce("root", "node").alias("label")
    labelled = banded.join(clusters, "node", "left").select("node", "band", "value", "size", label)
    code = lambda seed: F.bit_xor(F.xxhash64(F.col("node"), F.lit(seed)))
    by = labelled.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), code(1).alias("c1"), code(2).alias("c2"))
    bands = by.groupBy("band", "value").agg(
        F.max_by(F.struct("label", "n", "size"), F.struct("n", "label")).alias("major"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("labels"), F.bit_xor("c1").alias("c1"), F.bit_xor("c2").alias("c2"),
    ).where("labels > 1")
    bands = bands.groupBy("c1", "c2", "n").agg(F.min_by(F.struct("band", "value", "major", "size"), F.struct("band", "value")).alias("x"))
    of_major, of_minor = _blocks(F.col("x.major.n"), F.col("x.major.size")), _blocks(F.col("n") - F.col("x.major.n"), F.col("x.size") - F.col("x.major.size"))
    bands = scratch.save(bands.select("x.band", "x.value", F.col("x.major.label").alias("major"), of_major.alias("majors"), of_minor.alias("minors")), "bands")
    members = labelled.drop("size").join(bands, ["band", "value"])
    minor = F.col("label") != F.col("major")
    members = members.withColumn("minor", minor).withColumn("part", F.when(minor, F.col("majors") + _part(F.col("minors"))).otherwise(_part(F.col("majors"))))
    meets = F.sequence(F.when(minor, F.lit(0)).otherwise(F.col("majors")), F.col("majors") + F.col("minors") - 1)
    pairs = members.select("*", F.explode(meets).alias("with"))
    pairs = pairs.select(
        "band", "value", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), F.when(F.col("part") > F.col("with"), 1).otherwise(0).alias("side"), "label", "node"
    )
    return pairs.join(sets, "node").groupBy("band", "value", "i", "j").applyInArrow(_links, "a bigint, b bigint")


def text_classes(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, p1, p2, class_id, n): each different text of each doc_id, its class, and how many rows have it. Texts without words have no row."""
    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    signed = scratch.save(known.mapInArrow(_sign, "doc_id bigint, p1 bigint, p2 bigint, size bigint, bands array<bigint>"), "signed")
    groups = signed.groupBy("p1", "p2").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = scratch.save(groups, "groups")  # a table of its own: the join below can split a large group
    copy_of = F.coalesce("copy_of", "doc_id")
    copies = signed.join(groups, ["p1", "p2"], "left").select("doc_id", "p1", "p2", "size", copy_of.alias("copy_of"), F.when(copy_of == F.col("doc_id"), F.col("bands")).alias("bands"))
    copies = scratch.save(copies, "copies")
    first = copies.where(F.col("bands").isNotNull()).dropDuplicates(["doc_id", "p1", "p2"]).withColumnRenamed("doc_id", "node")
    banded = first.select("node", "p1", "p2", "size", F.posexplode("bands").alias("band", "value"))
    heads = scratch.save(banded.groupBy("band", "value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads")
    banded = scratch.save(banded.join(heads, ["band", "value"], "left_semi"), "banded")  # the others are alone in their bands
    nodes = banded.select("node", "p1", "p2").distinct()
    sets = known.join(nodes, F.col("doc_id") == F.col("node")).select("node", "p1", "p2", "text").mapInArrow(_sets, "node bigint, shingles binary, weights binary")
    sets = scratch.save(sets, "sets")
    links = scratch.save(_head_links(banded, sets, heads), "head_links")
    clusters = scratch.save(components(links, scratch, "clusters"), "clusters")
    more = scratch.save(_band_links(banded, sets, clusters, scratch), "band_links")
    if not more.isEmpty():
        star = clusters.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        clusters = scratch.save(components(star.unionByName(more), scratch, "classes"), "roots")
    found = copies.select("doc_id", "p1", "p2", "copy_of").join(clusters.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    found = found.groupBy("doc_id", "p1", "p2").agg(F.min(F.coalesce("root", "copy_of")).alias("class_id"), F.count(F.lit(1)).alias("n"))
    return scratch.save(found, "found")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document; class_id is the smallest doc_id of the class."""
    found = text_classes(documents, Scratch(documents.sparkSession)).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return documents.select(F.col("doc_id")).join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def first_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each class, the one with the smallest doc_id; of rows with equal id and words the first by text, then by the other columns."""
    scratch = Scratch(documents.sparkSession)
    found = text_classes(documents, scratch)
    ids = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n")).where("n > 1 or class_id <> doc_id")
    ids = scratch.save(ids.select(F.col("doc_id").alias("__id"), (F.col("n") > 1).alias("__several")), "decided")
    plain = documents.join(ids, F.col("doc_id") == F.col("__id"), "left_anti")
    several = documents.join(ids.where("__several"), F.col("doc_id") == F.col("__id"), "left_semi")
    marked = append_columns(several, "text", [T.StructField("__p1", T.LongType()), T.StructField("__p2", T.LongType())], fingerprints)
    told = found.select(F.col("doc_id").alias("__id"), F.col("p1").alias("__q1"), F.col("p2").alias("__q2"), "class_id").withColumnRenamed("class_id", "__class")
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__p1") == F.col("__q1")) & (F.col("__p2") == F.col("__q2"))
    own = marked.columns
    order = F.struct("text", F.to_json(F.struct(*(c for c in own if c != "text"))).alias("rest"))
    first = marked.groupBy("doc_id", "__p1", "__p2").agg(F.min_by(F.struct(*own), order).alias("first")).select("first.*")
    kept = first.join(told, same, "left").where("__class is null or __class = doc_id")
    return plain.select(*documents.columns).unionByName(kept.select(*documents.columns))
