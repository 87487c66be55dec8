"""Blocked nearest neighbours and filtered retrieval against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from admira.operators import nearest as N
from admira.operators import retrieve as V

Q = "question_id long, q array<float>, list string"
VEC = "id long, v array<float>, list string, note string"


def exact(a, b):
    d = 0.0
    for x, y in zip(a, b, strict=True):
        e = float(np.float32(x)) - float(np.float32(y))
        d += e * e
    return d


def sound(v):
    return bool(v) and all(x is not None and x == x for x in v)


def brute(questions, vectors, k):
    found = {}
    for i, q, li in questions:
        if sound(q):
            found.setdefault(i, []).extend((exact(q, v), j, note) for j, v, lj, note in vectors if lj == li and li is not None and sound(v) and len(v) == len(q))
    return sorted((i, j, rank, d, note) for i, rows in found.items() for rank, (d, j, note) in enumerate(sorted(rows)[:k], 1))


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    vec = lambda n: [rng.choice((0.0, 0.5, 1.0, 0.1)) for _ in range(n)]  # noqa: E731 - few values: many ties
    bad = [None, [], [1.0, None, 0.0], [float("nan"), 0.0, 1.0], [1.0, 2.0]]
    vectors = [(i, rng.choice((vec(3), vec(3), vec(3), vec(2), bad[i % 5])), rng.choice("aab"), f"n{i}") for i in range(160)] + [(i, [0.5, 0.5, 0.5], "a", "same") for i in range(900, 960)]
    questions = [(i, rng.choice((vec(3), vec(3), vec(2), bad[i % 5])), rng.choice(("a", "b", "none"))) for i in range(40)] + [(100, [0.5, 0.5, 0.5], "a"), (100, [0.5, 0.5, 0.5], "b")]
    q, v = spark.createDataFrame(questions, Q), spark.createDataFrame(vectors, VEC)
    for block in (4096, 7):
        got = N.nearest(q, v, 5, block=block)
        assert sorted((r.question_id, r.id, r.rank, r.distance, r.note) for r in got.collect()) == brute(questions, vectors, 5)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert N.nearest(q.limit(0), v, 5).count() == 0 and N.nearest(q, v.limit(0), 5).count() == 0


def test_what_the_matrix_product_blurs_is_measured_again():
    rng = np.random.default_rng(6)
    far = 1e4 + rng.random((300, 8)) * 1e-5  # products of 1e8 lose what tells these apart
    q = far[:20] + rng.random((20, 8)) * 1e-6
    for k in (1, 7, 400):
        rows, cols, dist = N.best_of(q, far, list(range(300)), k)
        for i in range(20):
            d = np.zeros(300)
            for j in range(8):
                d += (q[i, j] - far[:, j]) * (q[i, j] - far[:, j])
            want = sorted(range(300), key=lambda x: (d[x], x))[:k]
            assert cols[rows == i].tolist() == want and dist[rows == i].tolist() == d[want].tolist()


def test_retrieve_tiers_against_plain_python(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.random() for _ in range(3)], rng.choice(("x", "y", None)), rng.choice(("f", "g", None))) for i in range(60)]
    questions = [(i, [rng.random() for _ in range(3)], rng.choice(("x", "z", None)), rng.choice(([], None, ["f"], ["g", "f", "f"], ["none"], [None])), rng.random() < 0.5) for i in range(60)]
    got = V.retrieve(spark.createDataFrame(questions, "question_id long, q array<double>, want_entity string, want_categories array<string>, strict boolean"), spark.createDataFrame(vectors, "id long, v array<double>, entity string, category string"), 4)
    want = []
    for i, q, we, wc, strict in questions:
        tiers = [[r for r in vectors if (we is None or r[2] == we) and (not wc or (r[3] is not None and r[3] in wc))]]
        tiers.append([r for r in vectors if r[2] == we] if we is not None and wc else [])
        tiers.append(vectors if not strict and (we is not None or wc) else [])
        tier = next((t for t, rows in enumerate(tiers, 1) if rows), None)
        if tier:
            near = sorted((sum((a - b) ** 2 for a, b in zip(q, r[1], strict=True)), r[0]) for r in tiers[tier - 1])
            want += [(i, rank, j, tier) for rank, (_, j) in enumerate(near[:4], 1)]
    assert sorted((r.question_id, r.rank, r.id, r.tier) for r in got.collect()) == sorted(want)
    assert {w[3] for w in want} == {1, 2, 3}


def test_many_questions(spark):
    rows = spark.range(20_000).select(F.col("id").alias("question_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(1000)).cast("float")).alias("q"))
    vectors = rows.where("question_id < 3000").select(F.col("question_id").alias("id"), F.col("q").alias("v"))
    got = V.knn(rows, vectors, 3)
    assert got.count() == 60_000
    assert got.where("rank = 1 AND question_id < 3000 AND distance > 0").count() == 0
