"""Operators on small tables, sources and sinks, and streams against batches."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from admira.operators import blocks
from admira.operators import explore as X
from admira.operators import intents as I
from admira.operators import pages as G
from admira.operators import rank as R
from admira.operators import retrieve as V
from admira.sources import html, records
from admira.streaming import keyed as K
from admira.streaming import state as E

ALIASES = {"a_uni": ["alpha university", "alpha"], "b_uni": ["beta"]}


def test_json_round_trip_and_rebuild(spark, tmp_path):
    for name in ("x_normalized", "y_normalized"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"university": name, "tags": ["t"]}, indent=1))
    got = records.scan_json_records(spark, f"{tmp_path}/*.json", "university string, tags array<string>", "_normalized")
    assert sorted(r.stem for r in got.collect()) == ["x", "y"]
    out = f"{tmp_path}/out"
    assert records.ensure_built(spark, out, lambda: got)
    assert not records.ensure_built(spark, out, lambda: got)
    assert records.ensure_built(spark, out, lambda: got, force=True)
    assert spark.read.parquet(out).count() == 2


def test_spoiled_records_are_rejected_and_counted(spark, tmp_path):
    texts = {"a": '{"n": 1, "s": "x"}', "b": '{"n": 1, "s"', "c": '{"n": "one"}', "d": " ", "e": "{}", "f": '{"n": null, "more": 2}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    counts = Observation()
    good, rejected = records.scan_with_rejects(spark, str(tmp_path), "n int, s string", counts=counts)
    assert sorted((r.stem, r.n, r.s) for r in good.collect()) == [("a", 1, "x"), ("e", None, None), ("f", None, None)]
    assert counts.get == {"records": 6, "rejected": 3}
    assert sorted((r.stem, r.value) for r in rejected.collect()) == [("b", texts["b"]), ("c", texts["c"]), ("d", " ")]


def test_stage_is_built_again_when_interrupted_or_outdated(spark, tmp_path):
    source, out, ran = tmp_path / "in", f"{tmp_path}/out", []
    source.mkdir()

    def build(fail=False):
        ran.append(1)
        if fail:
            raise RuntimeError("lost")
        return spark.read.text(str(source))

    ask = lambda fail=False, **more: records.ensure_built(spark, out, lambda: build(fail), inputs=[str(source)], **more)
    (source / "a.txt").write_text("1")
    assert ask() and not ask() and len(ran) == 1
    (source / "b.txt").write_text("2")
    with pytest.raises(RuntimeError):
        ask(fail=True)
    assert ask() and not ask() and spark.read.parquet(out).count() == 2
    # the content alone decides where asked so
    assert ask(content=True) and not ask(content=True)
    os.utime(source / "a.txt", (1, 1))
    assert not ask(content=True)
    (source / "a.txt").write_text("3")
    assert ask(content=True)
    # an output without a manifest is half an output; an empty one with it is whole
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "x int").write.parquet(empty)
    nothing = lambda: spark.createDataFrame([], "x int")
    assert records.ensure_built(spark, empty, nothing) and not records.ensure_built(spark, empty, nothing)
    assert records.ensure_built(spark, empty, nothing, inputs=[f"{tmp_path}/missing"])


def test_pdf_records(spark, tmp_path):
    doc = {"source_url": "u", "saved_path": "p", "sha256": "s", "parsed": {"text": "t", "tables": [{"page": 1, "header": ["h"], "rows": [["1"]]}], "metadata": {"parser": "x", "pages_extracted": 1}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps(doc | {"parsed": {"text": "t", "tables": []}}))
    rows = records.scan_pdf_records(spark, str(tmp_path)).collect()
    assert sorted((r.page is None) for r in rows) == [False, True]
    heads = spark.createDataFrame([([["Name", "Fee"], ["a", "1"]],), ([["1", "2%"], ["a", "b"]],), ([],)], "rows array<array<string>>")
    assert [r.h for r in heads.select(records.guess_table_headers(F.col("rows")).alias("h")).collect()] == [["Name", "Fee"], None, None]


def test_html_tables_and_panels(spark):
    page = "<html><head><title> T &amp; U </title></head><body><nav>menu</nav><main>Hello <b>all</b><table><thead><tr><th>a</th></tr><tr><th>b</th></tr></thead><tr><td>1</td><td>2</td></tr></table><table><tr><td>x</td></tr><tr><td>y</td></tr></table><div class='panel'><h3>Fees</h3>told<table><tr><td>p</td></tr><tr><td>q</td></tr></table></div></main></body></html>"
    df = spark.createDataFrame([(1, "http://u", page), (2, "http://v", None)], "page_id long, url string, html string")
    rec = {r.page_id: r for r in html.html_to_page_record(df).collect()}
    assert rec[1].title == "T & U" and rec[1].content.startswith("Hello all") and "menu" not in rec[1].content
    rows = html.extract_html_tables(df).collect()
    tables = [(r.idx, r.cells, r.headers) for r in rows if r.kind == "table"]
    assert tables == [(0, ["1", "2"], ["a", "b"]), (1, ["y"], ["x"]), (2, ["q"], ["p"])]
    assert [(r.title, r.cells) for r in rows if r.kind == "panel"] == [("Fees", ["told"])]


def test_pages_become_records_and_chunks(spark, sf_dir):
    first = "<html><head><title>Eligibility</title></head><body><main><p>Applicants must have at least 60% marks in their intermediate examination.</p><p>Hostel rooms are available for students who live far away.</p></main><table><tr><th>Program</th><th>Fee per year</th></tr><tr><td>BS Alpha Studies</td><td>Rs 90,000</td></tr><tr><td>Master of Beta Design</td><td></td></tr></table></body></html>"
    second = "<html><head><title>Money</title></head><body><main>Every scholarship covers the whole tuition of a student. Applicants must have at least 60% marks in their intermediate examination.</main><table><tr><td>Degree</td></tr><tr><td>BS Alpha Studies</td></tr><tr><td>MS Gamma Analysis</td></tr></table></body></html>"
    rows = [(2, "https://b-uni.example/money", second), (1, "https://b-uni.example/eligibility", first), (3, "no address", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("b_uni.example", "North", "Town")], "entity_id string, province string, location string")
    got = {r.university: r for r in G.records_of_pages(pages, seeds).collect()}
    r = got["b-uni.example"]
    assert r.entity_id == "b_uni.example" and r.province == "North" and r.official_website == "https://b-uni.example"
    assert r.eligibility_criteria == ["Applicants must have at least 60% marks in their intermediate examination."]
    assert r.min_eligibility_percentage == 60.0 and r.hostel_available is True
    assert r.offered_courses == ["BS Alpha Studies", "Master of Beta Design", "MS Gamma Analysis"]
    assert [tuple(f) for f in r.fee_structure.fees] == [("BS Alpha Studies", "Fee per year: Rs 90,000")]
    assert r.source_pages == ["https://b-uni.example/eligibility", "https://b-uni.example/money"]
    assert len(r.scholarships) == 1 and got[""].offered_courses == [] and got[""].fee_structure.fees == []


def test_upsert_takes_the_last_batch(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, records.upsert_entities(t, [b], "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def _pairs(spark, **profile):
    p = {"profile_id": 1, "name": "n", "budget_pkr_per_semester": 100, "academic_percentage": 70.0, "field_of_study": "ring", "preferred_province": None, "preferred_cities": [], "hostel_required": False, "scholarship_required": False, "career_goals": None, "priority_focus": None, "latitude": None, "longitude": None} | profile
    ps = spark.createDataFrame([tuple(p.values())], "profile_id long, name string, budget_pkr_per_semester long, academic_percentage double, field_of_study string, preferred_province string, preferred_cities array<string>, hostel_required boolean, scholarship_required boolean, career_goals string, priority_focus string, latitude double, longitude double")
    es = spark.createDataFrame(
        [(1, "One", "City", "North", 100, "per_semester", 55.0, True, False, ["a ring b"], 24.9, 67.0), (2, "Two", "Town", "South", 230, "per_year", 60.0, False, True, [], 24.9, 67.1), (3, "Three", "", "", 9, "per_credit_hour", 80.0, None, False, ["c"], None, None)],
        "id long, name string, city string, province string, fee_amount int, fee_period string, min_eligibility double, hostel boolean, has_scholarships boolean, courses array<string>, latitude double, longitude double",
    )
    return ps, es


def test_gates_scores_and_focus(spark):
    ps, es = _pairs(spark)
    got = {r.id: r for r in R.recommend(ps, es).collect()}
    assert set(got) == {1, 2}  # the third asks for more than 70 %
    f = {x.criterion: x.score for x in got[1].factors}
    assert f == {"program_match": 100, "eligibility_match": 100, "budget_fit": 100, "location_fit": 60, "scholarship_fit": 60, "goal_alignment": 60}
    f2 = {x.criterion: x.score for x in got[2].factors}
    assert f2["eligibility_match"] == 90 and f2["budget_fit"] == 75 and f2["program_match"] == 40
    focus = spark.createDataFrame([(1, 0, 3), (1, 1, 99)], "profile_id long, pos int, id long")
    named = R.recommend(ps, es, focus=focus).collect()
    assert [(r.id, r.focused) for r in named] == [(3, True)]
    assert {x.criterion: x.score for x in named[0].factors}["eligibility_match"] == 70
    ps2, _ = _pairs(spark, priority_focus="fees")
    assert [x.criterion for x in R.recommend(ps2, es).first().factors][0] == "budget_fit"
    assert "One" in R.explain(R.recommend(ps, es)).where("id = 1").first().explanation


def test_big_side_goes_by_blocks(spark, monkeypatch):
    ps, es = _pairs(spark)
    want = sorted(R.recommend(ps, es).select("id", "total_score").collect())
    monkeypatch.setattr(blocks.bounded, "__defaults__", (1,))
    assert sorted(R.recommend(ps, es).select("id", "total_score").collect()) == want
    monkeypatch.setattr(R, "PLAIN", 1)
    assert sorted(R.recommend(ps, es).select("id", "total_score").collect()) == want


def test_intents(spark):
    df = spark.createDataFrame([(1, "compare Alpha University vs beta"), (2, "alpha, please"), (3, None)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", I.detect_entities(F.col("t"), ALIASES).alias("e")).collect()}
    assert got == {1: ["a_uni", "b_uni"], 2: ["a_uni"], 3: []}
    assert df.select(I.focus_entities(F.coalesce("t", F.lit("")), ALIASES).alias("f")).first().f == ["a_uni", "b_uni"]


def test_citations_and_fallbacks(spark):
    hits = spark.createDataFrame([(1, 1, "U", "http://x/a-b?q=1 | manual://some-note"), (1, 2, "U", ""), (1, 3, "U", "http://x/a-b?q=1"), (2, 1, None, None)], "question_id int, rank int, name string, source_pages string")
    got = {r.question_id: r.sources for r in V.source_citations(hits).collect()}
    assert got[1].split("\n") == ["- [U: a b](http://x/a-b?q=1)", "- U — some note (curated note)", "- U (university dataset)"]


def test_shortlists(spark):
    ev = spark.createDataFrame([(1, 10, "save"), (2, 10, "unsave"), (3, 10, "save"), (4, 10, "save"), (5, 11, "save"), (6, 11, "unsave")], "seq long, entity long, kind string").withColumn("student", F.lit(1)).withColumn("ts", F.col("seq"))
    got = E.shortlist_state(ev).collect()
    assert [(r.id, r.created_at) for r in got] == [(10, 3)]
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (1, "b")], "profile_id int, id string")
    before = spark.createDataFrame([(1, "b")], "profile_id int, id string")
    assert X.shortlist_counts(asked, before).first()[1:] == (3, 1)


def test_stream_equals_batch_and_replays(spark, tmp_path):
    rows = [(i, i % 5, ("save", "unsave", "save")[i % 3]) for i in range(60)]
    ev = spark.createDataFrame(rows, "seq long, entity long, kind string").withColumn("student", F.col("seq") % 2).withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    ev.repartitionByRange(4, "seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    K.stream_state(stream, K.shortlist_fold(), f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = K.read_state(spark, K.shortlist_fold(), f"{tmp_path}/state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.shortlist_state(ev).collect()))
