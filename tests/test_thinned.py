"""The best of each applicant where institutions are thinned, against every gated pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from admira.adapters import entities, offered, profiles
from admira.operators import cells
from admira.operators import rank as R
from test_cells import NAN, both  # noqa: F401


@pytest.fixture
def small(monkeypatch):
    """Few steps, blocks and levels, and kinds of any size thinned."""
    monkeypatch.setattr(R, "PLAIN", 1)
    for name, value in (("SHARED", 2), ("KINDS", 5), ("THINNED", 30), ("FIRST", 4), ("LISTS", 2), ("LEASTS", 2), ("BLOCK", 16)):
        monkeypatch.setattr(cells, name, value)


def test_best_of_thinned_institutions(both, small):  # noqa: F811
    p, e = both
    p = p.unionByName(p.withColumn("profile_id", F.col("profile_id") + 100)).unionByName(p.where("profile_id < 20").withColumn("profile_id", F.col("profile_id") + 200))
    own = W.partitionBy("profile_id").orderBy(F.desc("total_score"), "id")
    want = R.totals(p, e).withColumn("rank", F.row_number().over(own)).where("rank <= 3").select("profile_id", "id", "total_score", "rank")
    assert sorted(map(tuple, R.ranked_pairs(*R.prepared(p, e), 3).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("leasts", [64, 3])
def test_few_institutions_are_left_and_none_of_the_best(monkeypatch, leasts):
    for name, value in (("FIRST", 16), ("LEASTS", leasts)):
        monkeypatch.setattr(cells, name, value)
    rng, none = random.Random(5), {"hits": [], "across": [], "has_courses": False}
    one = lambda *x: rng.choice(x)
    es = [{"id": i, "least": one(None, NAN, 40.0, 50.0, 60.0, 70.0), "hostel": one(True, False), "place": one("", "n", "s"), "city": one("", "bay"), "area": "", "lat": one(None, 24.9, 25.3), "lon": 67.0, "fee": one(None, float(rng.randint(1, 9999))), "helps": one(True, False), "held": one("a", "b")} for i in range(2000)]
    kinds = [{"kind": 0, "cities": [], "wanted": "", "place": "", "lat": 24.9, "lon": 67.0}, {"kind": 1, "cities": ["bay"], "wanted": "n", "place": "n", "lat": None, "lon": None}]
    schema = pa.schema([("id", pa.int64()), ("least", pa.float64()), ("hostel", pa.bool_()), ("place", pa.string()), ("city", pa.string()), ("area", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("fee", pa.float64()), ("helps", pa.bool_()), ("held", pa.string())])
    table = pa.Table.from_pylist(es, schema)
    thin = cells.Thin(pa.Table.from_pylist(kinds), table, 2)
    wish = {"field": [], "whole": "", "goals": [], "has_goals": False, "priority": ""}
    for i, kind in enumerate(kinds):
        kept = set(thin.kept(i).tolist())
        assert len(kept) < (700 if leasts == 64 else 1200)  # with coarse levels the lowest one is kept
        ps = [kind | wish | {"pct": one(None, 45.0, 55.0, 75.0, NAN), "hostel": one(True, False), "budget": one(None, float(rng.randint(1, 9999))), "needs": one(True, False)} for _ in range(60)]
        cell = cells.Cell(pa.Table.from_pylist(ps).drop_columns(["kind"]), pa.Table.from_pylist([{k: v for k, v in r.items() if k != "held"} | none for r in es]))
        for s in cell.slices():
            for row in cells._rounded(cell.weighed(s, cells._weights([""] * 60, R.weight_sets()))):
                for held in ("a", "b"):  # lists of courses may add to any total
                    best = sorted((-t, r["id"]) for t, r in zip(row.tolist(), es, strict=True) if t >= 0 and r["held"] == held)[:2]
                    assert {x for _, x in best} <= kept


def test_recommendations_gather_no_course_lists(spark, sf_dir):
    p, e, taught = profiles(spark, sf_dir), entities(spark, sf_dir), offered(spark, sf_dir)
    bare = entities(spark, sf_dir, courses=False)
    want, got = R.recommend(p, e, 3), R.recommend(p, bare, 3, taught=taught)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "collect_set(text" not in R.recommend(p, bare, 3, taught=taught)._jdf.queryExecution().toString()


def test_more_phrases_than_bits(both, spark, monkeypatch):  # noqa: F811
    p, e = both
    links = e.select("id", F.explode("courses").alias("course"))
    taught = links, links.select("course", F.col("course").alias("text")).distinct()
    bare = e.drop("courses")
    few = sorted(map(tuple, R.rank_all(p, bare, 4, taught).collect()))
    monkeypatch.setattr(R, "BITS", 1)
    assert sorted(map(tuple, R.rank_all(p, bare, 4, taught).collect())) == few
    assert few == sorted(map(tuple, R.ranked_pairs(*R.prepared(p, e), 4).collect()))


@pytest.mark.parametrize("name", ["r12_recommend", "r12_recommend_with_chunks", "r10_explain", "r11_format_list", "r11_format_comparison", "s17_recommendations_markdown", "i8_find_recommendation"])
def test_queries_gather_no_course_lists(spark, sf_dir, monkeypatch, name):
    from admira.plans import ranking

    def made(spark, d, courses=True):
        assert not courses
        return entities(spark, d, courses=False)

    def ranked(profiles, entities, *limit, taught=None, **chunks):
        assert taught is not None and "courses" not in entities.columns
        return spark.createDataFrame([], "profile_id long, rank int, id long, name string, total_score int, distance_km double, factors array<struct<criterion:string,label:string,status:string,detail:string,score:int,weight:int>>, focused boolean, chunk_ids string, fallback string")

    monkeypatch.setattr(ranking, "entities", made)
    monkeypatch.setattr(R, "recommend", ranked)
    from admira.catalog import queries

    assert "courses" not in queries()[name](spark, sf_dir).columns
