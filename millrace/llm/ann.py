"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more dimension that makes all equally long, so that the largest inner product is the smallest
distance; a random rotation spreads their energy evenly. Lists belong to centroids fitted on a bounded sample,
every vector is in the list of its nearest centroid, and a query probes the lists of its nearest ones. Within a
list, distances are summed up block of dimensions by block, for all queries that ask for it at once; after each a hypothesis
test drops queries and candidates whose partial distances say that they have nothing among the nearest there. The
nearest by their whole distance are scored exactly, in double precision, on the original vectors.

How many lists are probed is measured on all vectors, not on the sample: one scan finds the exact answers of up to
``MEASURED`` of the queries, and as many lists are probed as hold ``RECALL`` of them. A query whose lists hold fewer
than k candidates goes on to the next ones.

Like lists stand side by side, and the vectors, list after list, are cut into groups of about ``PART``: a list is
in one group, or two, unless it is larger than a group, and what a query probes lies in few. A list with a third of all
vectors is many groups, and a group that many queries ask is copied for each ``PART`` of them. Each group returns a
query's nearest in it, and a window keeps the best of them.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor those of
another length than the most common one; a query with fewer candidates gets all of them; ties go to the smaller
vec_id; a row is no candidate of itself, but other rows with its vec_id are, and of several query rows with one vec_id
each has its own result; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bounded_sample

SAMPLE = 20_000  # bound of the vectors that centroids are fitted on
LISTS = 4_096  # bound of the number of lists
RECALL = 0.97  # of the measured queries' neighbours in the lists that are probed; the dimension test may lose some more
MEASURED = 256  # queries whose exact neighbours are found to measure it
K = 20
COLUMNS = 16  # dimensions that are added at a time
EPSILON = 2.1  # of the hypothesis test
PART = 32_768  # about the most vectors, and the most queries, in one task's group
NUMBERS = 1 << 22  # and the most components of them
GROUPS = 24
AT_ONCE = 1 << 21  # distances of a group's queries that are held at once: 16 MB
SEED = 10


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray  # (dims + 1) x (dims + 1), orthogonal
    centroids: np.ndarray  # rotated
    norm: float  # largest length of a vector


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    df = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    common = df.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.where(F.size("embedding") == (common[0]["n"] if common else 0))


def _stack(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2.0 * x @ c.T


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[at : at + 2048], centroids).argmin(axis=1) for at in range(0, len(x), 2048)])


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after some rounds of k-means."""
    for _ in range(rounds):
        near = _nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, rounds: int = 8, seed: int = SEED) -> Index | None:
    """Rotation and centroids (k-means) from at most about ``sample`` vectors."""
    rows = bounded_sample(vectors, "vec_id", sample, seed).orderBy("vec_id").select("embedding").toPandas()
    norm = vectors.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0]
    if not len(rows):
        return None
    x = _lengthened(np.stack(rows["embedding"].to_numpy()), norm)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    x = x @ rotation
    lists = int(min(max(n**0.5, 1), LISTS, len(x)))
    centroids = _means(x, x[np.sort(rng.choice(len(x), lists, replace=False))], rounds)
    above = _means(centroids, centroids[:: max(int(lists**0.5), 1)], rounds)
    centroids = centroids[np.argsort(_nearest(centroids, above), kind="stable")]  # like lists side by side
    return Index(rotation, centroids, float(norm))


def _probes(listed: DataFrame, every: int, k: int, shared) -> int:
    """Fewest lists that hold ``RECALL`` of the k nearest of up to ``MEASURED`` queries among all of ``listed``."""
    asked = bounded_sample(listed.where(F.col("vec_id") % every == 0), "vec_id", MEASURED, SEED).orderBy("row").limit(2 * MEASURED).select("row", "embedding").toArrow()
    if not asked.num_rows:
        return 1
    own = asked.column("row").to_numpy()
    queries = _stack(asked.column("embedding").combine_chunks()).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, lists = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                score = queries @ _stack(part.column(1)).astype(np.float64).T
                score[own[:, None] == part.column(0).to_numpy()] = -np.inf
                scores = np.column_stack([scores, score])
                lists = np.column_stack([lists, np.broadcast_to(part.column(2).to_numpy(), score.shape)])
                if scores.shape[1] > k:
                    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, lists = np.take_along_axis(scores, best, 1), np.take_along_axis(lists, best, 1)
        of = np.repeat(np.arange(len(own)), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(scores.ravel()), pa.array(lists.ravel(), pa.int32())], names=["query", "score", "list"])

    found = listed.select("row", "embedding", "list").mapInArrow(nearest, "query int, score double, list int")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "list")
    found = found.where(F.col("score") > F.lit(float("-inf"))).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).toArrow()  # MEASURED x k rows at most
    if not found.num_rows:
        return 1
    place = np.argsort(_ranked(queries, shared.rotation, shared.centroids), axis=1)
    needed = np.sort(place[found.column("query").to_numpy(), found.column("list").to_numpy()])
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def _ranked(queries: np.ndarray, rotation: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists of each query, the nearest first."""
    return np.argsort(_distances(np.column_stack([queries, np.zeros(len(queries))]) @ rotation, centroids), axis=1, kind="stable")


def scan(rotated: np.ndarray, edges: np.ndarray, queries: np.ndarray, wanted: list[list[int]], k: int) -> np.ndarray:
    """Squared distances of queries to the vectors of the lists that each wants (its nearest first); infinite for others and for those that the test excludes.

    ``rotated`` stands list after list, ``edges`` are their bounds. A list is held against all queries that want it, a block of
    dimensions at a time; queries and vectors that the test leaves no partner in it go on no further.
    """
    dims = rotated.shape[1]
    out, bound = np.full((len(queries), len(rotated)), np.inf), np.full(len(queries), np.inf)
    for i, lists in enumerate(wanted):
        head = rotated[edges[lists[0]] : edges[lists[0] + 1]][: k + 1]  # their whole distances are the bound; one of them may be the query's own row
        if len(head) > k:
            bound[i] = ((head - queries[i]) ** 2).sum(axis=1).max()
    of = np.concatenate([np.asarray(x, np.int64) for x in wanted])
    who = np.repeat(np.arange(len(queries)), [len(x) for x in wanted])
    order = np.argsort(of, kind="stable")
    found, begin = np.unique(of[order], return_index=True)
    for w, rows in zip(found, np.split(who[order], begin[1:]), strict=True):
        columns = np.arange(edges[w], edges[w + 1])
        x, q = rotated[edges[w] : edges[w + 1]], queries[rows]
        partial = np.zeros((len(rows), len(columns)))
        for at in range(0, dims, COLUMNS):
            a, b, seen = q[:, at : at + COLUMNS], x[:, at : at + COLUMNS], min(at + COLUMNS, dims)
            partial += np.column_stack([-2.0 * a, np.ones(len(a)), (a * a).sum(axis=1)]) @ np.column_stack([b, (b * b).sum(axis=1), np.ones(len(b))]).T
            if seen == dims:
                out[rows[:, None], columns] = partial
                break
            keep = partial <= (bound[rows] * ((1.0 + EPSILON / seen**0.5) ** 2 * seen / dims))[:, None]
            stay, held = keep.any(axis=1), keep.any(axis=0)
            if not stay.any():
                break
            if stay.sum() * held.sum() < 0.75 * partial.size:
                rows, columns, x, q, partial = rows[stay], columns[held], x[held], q[stay], partial[stay][:, held]
    return out


def _nearest_pairs(distances: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is as near as the row's kth, or by rounding might be."""
    last = np.full((len(distances), 1), np.inf)
    if distances.shape[1] > k:
        last = np.partition(distances, k - 1, axis=1)[:, k - 1 : k] + slack
    return np.nonzero((distances <= last) & np.isfinite(distances))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def search(vectors: DataFrame, every: int = 20, k: int = K, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    good = usable(vectors)
    kind = "array<double>" if "double" in dict(good.dtypes)["embedding"] else "array<float>"
    good = scratch.save(good.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), F.monotonically_increasing_id().alias("row")), "vectors")
    n = good.count()
    index = fit(good, n, sample)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centroids)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _nearest(_lengthened(_stack(part.column(1)), index.norm) @ index.rotation, index.centroids)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(near, pa.int32())], names=["vec_id", "embedding", "row", "list"])

    listed = scratch.save(good.mapInArrow(home, f"vec_id bigint, embedding {kind}, row bigint, list int"), "lists")
    probes = min(probes or _probes(listed, every, k, index), lists)
    sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each list: LISTS at most
        sizes[r["list"]] = r["count"]
    starts = np.cumsum(sizes) - sizes
    part = max(min(PART, NUMBERS // index.rotation.shape[0], -(-n // GROUPS)), 1)
    first, last = starts // part, (starts + np.maximum(sizes, 1) - 1) // part  # groups of a list

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                near = _ranked(_stack(rows.column(1)).astype(np.float64), index.rotation, index.centroids)
                held = np.cumsum(sizes[near], axis=1)
                enough = (held < k + 1).sum(axis=1) + 1
                group, row, wanted = [], [], []
                for i, ranked in enumerate(near):
                    ranked = ranked[: max(probes, enough[i])]
                    ranked = ranked[sizes[ranked] > 0]
                    n_groups = last[ranked] - first[ranked] + 1
                    of = np.repeat(ranked, n_groups)
                    in_group = np.repeat(first[ranked] - np.cumsum(n_groups) + n_groups, n_groups) + np.arange(n_groups.sum())
                    order = np.argsort(in_group, kind="stable")  # within a group the nearest list first
                    found, begin = np.unique(in_group[order], return_index=True)
                    group.extend(found.tolist())
                    row.extend([i] * len(found))
                    wanted.extend(np.split(of[order].astype(np.int32), begin[1:]))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, pa.int64()), *(rows.column(c).take(take) for c in range(3)), pa.array(wanted, pa.list_(pa.int32()))],
                    names=["group", "vec_id", "embedding", "row", "lists"],
                )

    asked = good.where(F.col("vec_id") % every == 0).mapInArrow(ask, f"group bigint, vec_id bigint, embedding {kind}, row bigint, lists array<int>")
    asked = scratch.save(asked, "asked")
    calls = scratch.save(asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("calls")), "calls")
    table = spark.createDataFrame([(i, int(a), int(max(m, 1))) for i, (a, m) in enumerate(zip(starts, sizes, strict=True))], "list int, start bigint, size bigint")
    place = F.col("start") + F.pmod(F.xxhash64("row", F.lit(3)), F.col("size"))
    candidates = listed.join(F.broadcast(table), "list").select(F.floor(place / part).alias("group"), "list", "vec_id", "embedding", "row")  # LISTS rows at most
    candidates = candidates.join(calls, "group").withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).drop("calls")
    queries = asked.join(calls, "group").withColumn("call", F.pmod(F.xxhash64("row", F.lit(4)), F.col("calls")).cast("int")).drop("calls")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            index = shared.value
            left = left.sort_by([("list", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
            ids, of, rows = (left.column(c).to_numpy() for c in ("vec_id", "list", "row"))
            x = _stack(left.column("embedding").combine_chunks())
            rotated = _lengthened(x, index.norm) @ index.rotation
            edges = np.searchsorted(of, np.arange(lists + 1))
            q = _stack(right.column("embedding").combine_chunks())
            turned = np.column_stack([q.astype(np.float64), np.zeros(len(q))]) @ index.rotation
            asking, row, wanted = right.column("vec_id").to_numpy(), right.column("row").to_numpy(), right.column("lists").to_pylist()
            by_row = np.argsort(rows)
            at_once = max(AT_ONCE // len(rows), 1)
            for at in range(0, len(q), at_once):
                end = min(at + at_once, len(q))
                distance = scan(rotated, edges, turned[at:end], wanted[at:end], k)
                own = by_row[np.minimum(np.searchsorted(rows, row[at:end], sorter=by_row), len(rows) - 1)]
                same = np.flatnonzero(rows[own] == row[at:end])
                distance[same, own[same]] = np.inf
                i, c = _nearest_pairs(distance, k, 1e-9 * (index.norm**2 + 1e-300))
                score = np.concatenate([_exact(x[c[n : n + 65_536]], q[at + i[n : n + 65_536]]) for n in range(0, max(len(i), 1), 65_536)])
                order = np.lexsort((rows[c], ids[c], -score, i))
                i, c, score = i[order], c[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, c, score = at + i[best], c[best], score[best]
                out.append((asking[i], row[i], ids[c], rows[c], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        names = ("query_id", "query_row", "vec_id", "row", "score")
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in zip(names, columns, strict=True)})

    schema = "query_id bigint, query_row bigint, vec_id bigint, row bigint, score double"
    found = candidates.groupBy("group", "call").cogroup(queries.groupBy("group", "call")).applyInArrow(match, schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
