"""Exact nearest neighbours within lists, block against block.

Questions and vectors belong to lists; a question meets the vectors of its lists only. A list's vectors and questions are
dealt to blocks of about ``BLOCK`` rows, and every pair of blocks is one group of a cogroup, so a group's size is bounded
however large a list is, and no pair of rows is ever a row. Within a group, distances come from a matrix product; what lies
within its rounding error of the k-th is measured again exactly, as a sum over the components in order. The best k of each
question and group are merged by a window.

Defined results: ties go to the smaller id; vectors that are null, empty or hold null or NaN components take no part, on
either side; a question meets vectors of its own length only; a question named for several lists is merged over them; a list
without vectors gives nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocks import deal

#: Rows of a block, on either side, about.
BLOCK = 4096
#: Questions of a block whose distances are held at a time.
SLICE = 256


def _sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


def best_of(q: np.ndarray, v: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, distance): the k nearest rows of ``v`` for each row of ``q``, ties to the smaller id."""
    v2 = np.einsum("ij,ij->i", v, v)
    rows, cols, dist = [], [], []
    for a in range(0, len(q), SLICE):
        part = q[a : a + SLICE]
        q2 = np.einsum("ij,ij->i", part, part)
        near = q2[:, None] + v2[None, :] - 2.0 * (part @ v.T)
        error = 8.0 * (v.shape[1] + 4) * np.finfo(np.float64).eps * (q2 + v2.max()) + np.finfo(np.float64).tiny
        edge = np.partition(near, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1] + 2 * error
        for i in range(len(part)):
            at = np.flatnonzero(near[i] <= edge[i])
            exact = np.zeros(len(at))
            for j in range(v.shape[1]):  # in order, as a fold over the components
                d = part[i, j] - v[at, j]
                exact += d * d
            if len(at) > 4 * k:
                close = exact <= np.partition(exact, k - 1)[k - 1]
                at, exact = at[close], exact[close]
            best = sorted(range(len(at)), key=lambda x: (exact[x], ids[at[x]]))[:k]
            rows += [a + i] * len(best)
            cols += at[best].tolist()
            dist += exact[best].tolist()
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(dist, dtype=np.float64)


def nearest(questions: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """questions(question_id, q, list) with the k nearest of vectors(id, v, list, ...): question_id, id, distance, rank and
    the further columns of the vectors."""
    more = [c for c in vectors.columns if c not in ("id", "v", "list")]
    in_list = lambda v: F.struct("list", F.size(v).alias("dims"))
    q = questions.where(_sound(F.col("q"))).select("question_id", "q", in_list("q").alias("l"))
    v = vectors.where(_sound(F.col("v"))).select("id", "v", *more, in_list("v").alias("l"))
    q, v = deal(q, v, "l", "question_id", "id", block, block)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["question_id", "id", *more, "distance"]
        if not len(left) or not len(right):
            return pa.table({n: (left if n == "question_id" else right).column(n).slice(0, 0) if n != "distance" else pa.array([], pa.float64()) for n in names})
        i, j, d = best_of(_matrix(left.column("q")), _matrix(right.column("v")), right.column("id").to_pylist(), k)
        made = {"question_id": left.column("question_id").take(i)} | {n: right.column(n).take(j) for n in ("id", *more)} | {"distance": pa.array(d)}
        return pa.table(made)

    kinds = {f.name: f.dataType for f in [*q.schema, *v.schema]}
    schema = ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in ("question_id", "id", *more)) + ", distance double"
    keys = ("l", "lb", "rb")
    met = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(meet, schema)
    first = F.row_number().over(W.partitionBy("question_id").orderBy("distance", "id"))
    return met.withColumn("rank", first).where(F.col("rank") <= k)
