"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves; each half has its own codebook of centroids, so a pair of centroids
names a cell. A query visits cells by the sum of its two half distances: a heap walks the grid of both sorted distance
lists until the visited cells hold ``visit`` of all entries. Entries of visited cells are ranked by the exact cosine.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors); every vector is indexed. Vectors of one direction are one
entry with their smallest ids, which is exact for the k nearest as ties go to the smaller id: a vector is divided by its
largest component, which gives multiples of a vector the same bits. The ranking works in blocks of ``QUERIES`` queries by
``ENTRIES`` entries of one first centroid, some MB each, as matrix products; per query and block the best k+1 leave.

The index holds the vectors of the commonest length. Those of every other length are compared exactly, each length by itself,
in blocks of queries by blocks of entries of ``BLOCK_BYTES``; a vector has a cosine with vectors of its length only.

Defined results: null vectors, vectors with null or non-finite components and zero vectors take no part; rows with a query's
id are never its candidates; of rows that share an id and a length one is the query; a query without candidates of its length
has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, stage

#: The parameter that bounds the sample for the codebooks.
SAMPLE = 8192
#: Centroids of a half at most.
CENTROIDS = 64
#: Share of the entries that a query visits, and entries that it visits at least. Recall is measured in the tests.
VISIT, VISIT_LEAST = 0.5, 2000
#: Entries and queries that meet in a task, and queries of one matrix product.
ENTRIES, QUERIES, STRIP = 8192, 8192, 128
#: Bytes of the vectors in a block of a rarer length, one vector at least.
BLOCK_BYTES = 4 << 20


def _matrix(col: pa.Array) -> np.ndarray:
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, dtype="<f8").reshape(len(col), -1)


def direction(v: list[float]) -> np.ndarray:
    """The vector divided by its largest absolute component, without negative zeros."""
    x = np.array(v, dtype="<f8")
    return x / np.abs(x).max() + 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T


def visited_cells(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells in order of d1[i] + d2[j] until they hold ``wanted`` entries. The heap holds the frontier of the grid."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    grid = counts[np.ix_(o1, o2)].tolist()
    heap, reached, found, held = [(s1[0] + s2[0], 0, 0)], [-1] * len(s1), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if grid[i][j]:
            found.append((int(o1[i]), int(o2[j])))
            held += grid[i][j]
        reached[i] = j
        # a cell is a candidate once both its left and its upper neighbour are visited
        if j + 1 < len(s2) and (i == 0 or reached[i - 1] >= j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < len(s1) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return found


def _valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & F.col("id").isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return rows.withColumn("dims", F.size("v"))


def best_of(score: np.ndarray, ids: list[list[int]], own: int, k: int) -> list[tuple[float, int]]:
    """(score, id) of the entries among which the k best ids other than ``own`` are; an entry holds its ids in order."""
    at = np.arange(len(score))
    if len(score) > k + 1:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
    best = sorted(zip((-score[at]).tolist(), [ids[j] for j in at], strict=True))[: k + 1]
    return [(-x, y) for x, ys in best for y in ys if y != own]


def _found(out: list[tuple]) -> pa.Table:
    cols = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "score": pa.array(cols[1], pa.float64()), "vec_id": pa.array(cols[2], pa.int64())})


def _each_length(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, score, vec_id: the nearest of each block, among the vectors of the query's length."""
    whole = F.floor(F.lit(BLOCK_BYTES) / (F.col("dims") * 8))
    held = F.greatest(F.lit(1), F.least(F.lit(ENTRIES), whole))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / held)).cast("int")
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("m")).where("m > 0")
    sizes = stage(sizes.select(F.col("dims").alias("d"), parts(F.col("n")).alias("es"), parts(F.col("m")).alias("qs")), "lengths")
    met = rows.join(bounded(sizes, sizes.count()), F.col("dims") == F.col("d"))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = met.where(is_query).groupBy("id", "dims").agg(F.min("v").alias("v"), F.first("es").alias("es"), F.first("qs").alias("qs"))
    left = asked.select("id", "v", "dims", block("qs").alias("q"), every("es").alias("e")).groupBy("dims", "e", "q")
    right = met.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.col("dims").alias("rd"), block("es").alias("re"), every("qs").alias("rq")).groupBy("rd", "re", "rq")

    def units(col) -> np.ndarray:
        return _unit(np.array([direction(v) for v in col.to_pylist()]))

    def rank(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(entries):
            own: dict[bytes, list[int]] = {}
            for i, v in zip(entries["rid"].to_pylist(), entries["rv"].to_pylist(), strict=True):
                own.setdefault(direction(v).tobytes(), []).append(i)
            ids = [sorted(set(x))[: k + 1] for x in own.values()]
            e, q, names = _unit(np.array([np.frombuffer(x, dtype="<f8") for x in own])), units(queries["v"]), queries["id"].to_pylist()
            for first in range(0, len(q), STRIP):
                for i, s in enumerate(q[first : first + STRIP] @ e.T, first):
                    out += [(names[i], *x) for x in best_of(s, ids, names[i], k)]
        return _found(out)

    return left.cogroup(right).applyInArrow(rank, "query_id long, score double, vec_id long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, visit: float = VISIT, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row where ``is_query`` (a column of ``id``)."""
    spark = vectors.sparkSession
    valid = _valid(vectors, vec_id, vector)
    lengths = valid.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(2).collect()
    common = F.lit(lengths[0].dims if lengths else 0)
    rows = valid.where(F.col("dims") == common).select("id", "v")

    def combine(batches):
        """Vectors of one direction become one row of a batch, with their k + 1 smallest ids."""
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(direction(v).tobytes(), []).append(i)
            ids = [sorted(set(x))[: k + 1] for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["v", "ids"])

    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k + 1)
    merged = rows.mapInArrow(combine, "v binary, ids array<bigint>").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(32)))
    entries = stage(merged.groupBy("v", "salt").agg(least("ids").alias("ids")).groupBy("v").agg(least("ids").alias("ids")), "entries")
    n = entries.count()
    scale = 1 << 20
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(scale)) * n < SAMPLE * scale).select("v").toArrow()["v"]
    x = _unit(_matrix(sample)) if len(sample) else np.zeros((0, 2))
    half = x.shape[1] // 2
    centroids = max(1, min(CENTROIDS, int(np.sqrt(n) / 1.5), len(x)))
    books = (kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)) if len(x) else (np.zeros((1, 1)), np.zeros((1, 1)))
    shared = spark.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            if len(batch):
                u = _unit(_matrix(batch.column(0)))
                a = _distances(u[:, :half], shared.value[0]).argmin(axis=1)
                b = _distances(u[:, half:], shared.value[1]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *batch.columns], names=["a", "b", "v", "ids"])

    index = stage(entries.mapInArrow(assign, "a int, b int, v binary, ids array<bigint>"), "index")
    counts = np.zeros((centroids, centroids), dtype=np.int64)
    for r in index.groupBy("a", "b").count().collect():  # a row for each cell, CENTROIDS squared at most
        counts[r.a, r.b] = r["count"]
    blocks = spark.sparkContext.broadcast((counts, -(-counts.sum(axis=1) // ENTRIES)))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = stage(asked, "queries")
    query_blocks = max(1, -(-asked.count() // QUERIES))
    wanted = max(visit * n, VISIT_LEAST)

    def traverse(batches):
        for batch in batches:
            out = []
            grid, parts = blocks.value
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = direction(v)
                u = _unit(q[None])
                cells = visited_cells(_distances(u[:, :half], shared.value[0])[0], _distances(u[:, half:], shared.value[1])[0], grid, wanted)
                lists: dict[int, list[int]] = {}
                for a, b in cells:
                    lists.setdefault(a, []).append(b)
                out += [(i, q.tobytes(), a, e, bs) for a, bs in lists.items() for e in range(int(parts[a]))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "v", "a", "e", "bs"])

    block = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    queries = asked.mapInArrow(traverse, "id long, v binary, a int, e int, bs array<int>").withColumn("q", block)
    parts = spark.range(centroids).select(F.col("id").cast("int").alias("a"), F.element_at(F.lit([int(p) for p in blocks.value[1]]), (F.col("id") + 1).cast("int")).alias("p"))
    mine = F.pmod(F.xxhash64("v"), F.col("p")).cast("int")
    listed = index.join(F.broadcast(parts), "a").select("a", "b", "v", "ids", mine.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            every, e = _unit(_matrix(left["v"])), _unit(_matrix(right["v"]))
            cell, ids = right["b"].to_numpy(), right["ids"].to_pylist()
            names, lists = left["id"].to_pylist(), left["bs"].to_pylist()
            open_ = np.zeros(centroids, dtype=bool)
            for first in range(0, len(every), STRIP):
                score = every[first : first + STRIP] @ e.T
                for i, s in enumerate(score, first):
                    open_[:] = False
                    open_[lists[i]] = True
                    at = np.flatnonzero(open_[cell])
                    out += [(names[i], *x) for x in best_of(s[at], [ids[j] for j in at], names[i], k)]
        return _found(out)

    left = queries.select("id", "v", "bs", "a", "e", "q").groupBy("a", "e", "q")
    right = listed.select(F.col("b"), F.col("v"), F.col("ids"), F.col("a").alias("ra"), F.col("e").alias("re"), F.col("q").alias("rq")).groupBy("ra", "re", "rq")
    near = left.cogroup(right).applyInArrow(rank, "query_id long, score double, vec_id long")
    if len(lengths) > 1:
        near = near.unionByName(_each_length(valid.where(F.col("dims") != common), is_query, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(vec_id), "score")
