"""Scores of all gated pairs by cells against the joined pairs, on odd values and small blocks."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from admira.operators import candidates, cells
from admira.operators import rank as R

NAN = float("nan")


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(31)
    one = lambda *x: rng.choice(x)
    ps = [
        (i, one(None, NAN, 0.0, 49.5, 60.0, 75.25, 101.0), one(None, True, False), one(None, "", " North", "south"), one(None, [], ["Bay Town", None], ["old"]), one(None, 0, 100, 87, 115, -50), one(None, True, False),
         one(None, "fees", " Distance ", "other"), one(None, 24.9, 0.0), one(None, 67.0, 70.0), one(None, "", "Art", "art, law", "law of"), one(None, "", "work in law", "of art"))
        for i in range(70)
    ]
    es = [
        (i * 3, f"E{i}", one(None, "", "bay", "Old Bay Town"), one(None, "", "north ", "South West"), one(None, 0, 100, 115, 135, 999), one(None, "per_year", "per_credit_hour"), one(None, NAN, 49.5, 60.0, 75.0), one(None, True, False),
         one(None, True, False), one(None, 0.0, 24.9, 25.0), one(None, 67.0, 67.1), one(None, [], ["Fine Art"], ["Law", "of man"], ["x"]))
        for i in range(55)
    ]
    p = spark.createDataFrame(ps, "profile_id long, academic_percentage double, hostel_required boolean, preferred_province string, preferred_cities array<string>, budget_pkr_per_semester int, scholarship_required boolean, priority_focus string, latitude double, longitude double, field_of_study string, career_goals string")
    e = spark.createDataFrame(es, "id long, name string, city string, province string, fee_amount int, fee_period string, min_eligibility double, hostel boolean, has_scholarships boolean, latitude double, longitude double, courses array<string>")
    return p, e


@pytest.fixture(params=[(16384, 1 << 20, 256), (16, 40, 4)])
def blocks(request, monkeypatch):
    for name, value in zip(("BLOCK", "AT_ONCE", "LEAST"), request.param, strict=True):
        monkeypatch.setattr(cells, name, value)


def test_sums_and_best_of_all_pairs(both, blocks):
    every = R.totals(*both).cache()
    got = R.total_sums(*both)
    want = every.groupBy("profile_id").agg(F.count("*"), F.sum("total_score"), F.max("total_score"), F.round(F.max("km"), 6))
    assert sorted(map(tuple, got.withColumn("farthest", F.round("farthest", 6)).collect())) == sorted(map(tuple, want.collect()))
    own = W.partitionBy("profile_id").orderBy(F.desc("total_score"), "id")
    want = every.withColumn("rank", F.row_number().over(own)).where("rank <= 7").select("profile_id", "id", "total_score", "rank")
    assert sorted(map(tuple, R.ranked_pairs(*R.prepared(*both), 7).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", list(R._PASSING))
def test_counts_of_scores_of_all_pairs(both, blocks, name):
    s = F.col(f"s_{name}")
    scored = R.factor_scores(R.candidate_pairs(*both)).groupBy(s["score"].alias("score"), s["status"].alias("status"))
    want = scored.agg(F.count("*"), F.sum("e.id"))
    assert sorted(map(tuple, R.score_counts(*both, name).collect())) == sorted(map(tuple, want.collect()))


def test_nothing_is_sent_whole(both):
    """Joins with copies of rows for every block of the other side were planned as broadcasts, by the size before the copies."""
    for df in (R.total_sums(*both), R.score_counts(*both, "budget_fit"), R.ranked_pairs(*R.prepared(*both), 5)):
        assert "Broadcast" not in df._jdf.queryExecution().toString()
    assert all(r.id is not None for r in R.recommend(*both, 3).collect())


def test_numbers_of_gated_pairs_without_pairs(both):
    met = R.gated_ids(*both).cache()
    sums, counts = candidates.gated_sums(*both), candidates.gated_counts(*both)
    want = met.groupBy("profile_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    assert sorted(map(tuple, sums.select("profile_id", "n", "ids").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, counts.select("id", "n").collect())) == sorted(map(tuple, met.groupBy("id").count().collect()))
    for df in (sums, counts):  # the pairs themselves were joined
        assert "sequence(" not in df._jdf.queryExecution().toString()  # no blocks


def test_courses_as_rows_give_what_lists_give(spark):
    """Each text is searched once; lists of institutions were gathered and searched whole, twice."""
    wish = [(1, "Fine Art", "fine art"), (2, "art law", "in law"), (3, "music", ""), (4, None, "art"), (5, "law", None)]
    p = spark.createDataFrame([(i, None, None, None, None, 0, None, None, None, None, f, g) for i, f, g in wish], "profile_id long, academic_percentage double, hostel_required boolean, preferred_province string, preferred_cities array<string>, budget_pkr_per_semester int, scholarship_required boolean, priority_focus string, latitude double, longitude double, field_of_study string, career_goals string")
    courses = {10: "Fine Art", 11: "Law", 12: "Fine Arts of Law", 13: "History", 14: None}
    links = [(0, 10), (0, 11), (0, 11), (1, 12), (2, 13), (3, 99), (4, 14)]  # a course twice, one that is nowhere, one without text
    bare = "id long, name string, city string, province string, fee_amount int, fee_period string, min_eligibility double, hostel boolean, has_scholarships boolean, latitude double, longitude double"
    e = spark.createDataFrame([(i, f"E{i}", *[None] * 9) for i in range(6)], bare)
    lists = {i: sorted({courses[c] for j, c in links if j == i and courses.get(c)}) for i in range(6)}
    listed = e.join(spark.createDataFrame(list(lists.items()), "id long, courses array<string>"), "id")
    taught = spark.createDataFrame(links, "id long, course long"), spark.createDataFrame(list(courses.items()), "course long, text string")
    for asked in (p, p.where("profile_id > 2")):  # with and without phrases that reach across
        for name in ("program_match", "goal_alignment"):
            want = sorted(map(tuple, R.score_counts(asked, listed, name).collect()))
            assert sorted(map(tuple, R.score_counts(asked, e, name, taught).collect())) == want
        assert sorted(map(tuple, R.total_sums(asked, e, taught).collect())) == sorted(map(tuple, R.total_sums(asked, listed).collect()))
        scored = R.factor_scores(R.candidate_pairs(asked, listed)).groupBy(F.col("s_goal_alignment")["score"].alias("score")).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, scored.collect())) == sorted((r.score, r.n) for r in R.score_counts(asked, e, "goal_alignment", taught).collect())
