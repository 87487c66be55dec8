"""Joins of applicants by shuffle, whatever the bytes of their files, and factors that read no course lists."""

from pyspark.sql import functions as F

from admira.adapters import entities, profiles
from admira.operators import rank as R
from admira.sources.folders import stage
from admira.sources.records import recommendations_markdown


def sent(df, name):
    """The broadcast joins of a plan that are on a column."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return [x for x in lines if "BroadcastHashJoin" in x and name in x]


def test_applicants_and_their_best_are_not_sent(spark, sf_dir):
    p, e = profiles(spark, sf_dir), entities(spark, sf_dir)
    ranked = R.recommend(p, e)
    asked, aliases = p.select("profile_id", F.lit("the first").alias("question")), e.select("id", F.col("name").alias("alias"))
    assert sent(p.join(stage(p.select("profile_id"), "small"), "profile_id"), "profile_id")  # small enough to be sent
    for df in (ranked, recommendations_markdown(ranked, p), R.find_recommendation(asked, ranked, aliases)):
        assert sent(df, "profile_id") == []


def test_parts_are_not_sent_to_order_lines(spark, sf_dir):
    assert sent(entities(spark, sf_dir), "partkey") == []


def test_factors_without_courses_read_none(spark, sf_dir):
    p, e = profiles(spark, sf_dir), entities(spark, sf_dir)
    broken = e.withColumn("courses", F.array(F.raise_error(F.concat(F.lit("read "), F.col("id").cast("string"))).cast("string")))
    for name in ("eligibility_match", "budget_fit", "scholarship_fit", "location_fit"):
        found = R.score_counts(p, broken, name)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.score_counts(p, e, name).collect()))


def test_budget_points_fall_as_fees_rise():
    import numpy as np
    import pyarrow as pa

    from admira.operators.cells import Cell

    budgets, fees = [None, 0.0, -10.0, 100.0, 77.0, float("inf"), 3e5], [None, 0.0, 100.0, 115.0, 115.01, 135.0, 136.0, 1.0, -20.0, 77.0, 88.55, 1e6]
    p = {"pct": None, "hostel": False, "place": "", "cities": [], "wanted": "", "lat": None, "lon": None, "needs": False, "priority": "", "field": [], "whole": "", "goals": [], "has_goals": False}
    e = {"least": None, "hostel": True, "place": "", "city": "", "area": "", "lat": None, "lon": None, "helps": False, "hits": [], "across": [], "has_courses": False}
    cell = Cell(pa.Table.from_pylist([p | {"profile_id": i, "budget": b} for i, b in enumerate(budgets)]), pa.Table.from_pylist([e | {"id": i, "fee": f} for i, f in enumerate(fees)]))

    def one(own, fee):
        if not own or not fee:
            return 55
        over = (fee - own) / own
        return 100 if fee <= own else 75 if over <= 0.15 else 45 if over <= 0.35 else 20

    got = np.concatenate([cell.points("budget_fit", s) for s in cell.slices()])
    assert got.tolist() == [[one(b, f) for f in fees] for b in budgets]


def test_budget_counts_without_pairs(monkeypatch):
    """Counts by orders of minimums and fees are those of the pairs, which are not looked at."""
    import random

    import pyarrow as pa

    from admira.operators import cells

    rng, nan = random.Random(3), float("nan")
    one = lambda *x: rng.choice(x)
    p = {"cities": [], "wanted": "", "lat": None, "lon": None, "needs": False, "priority": "", "field": [], "whole": "", "goals": [], "has_goals": False}
    e = {"city": "", "area": "", "lat": None, "lon": None, "helps": False, "hits": [], "across": [], "has_courses": False}
    ps = [{"pct": one(None, nan, 45.0, 55.0, 65.5), "hostel": one(True, False), "place": one("", "n", "s"), "budget": one(None, 0.0, 100.0, -50.0, float(rng.randint(1, 400))), "n": rng.randint(1, 5)} for _ in range(80)]
    es = [{"least": one(None, nan, 40.0, 50.0, 65.5), "hostel": one(True, False), "place": one("", "n", "s"), "fee": one(None, 0.0, -20.0, 100.0, 115.0, 135.0, float(rng.randint(1, 600))), "n": rng.randint(1, 4), "ids": rng.randint(1, 999)} for _ in range(70)]
    a, b = pa.Table.from_pylist([r | p for r in ps]), pa.Table.from_pylist([r | e for r in es])
    cell, want = cells.Cell(a.drop_columns(["n"]), b.drop_columns(["n", "ids"])), {}
    for s in cell.slices():
        for i, row in enumerate(cell.points("budget_fit", s).tolist(), s.start):
            for x, r in zip(row, es, strict=True):
                n, ids = want.get(x, (0, 0))
                want[x] = n + ps[i]["n"] * r["n"], ids + ps[i]["n"] * r["ids"]
    monkeypatch.setattr(cells.Cell, "points", None)
    assert cells.priced_pairs(a, b) == {k: v for k, v in want.items() if k >= 0}
