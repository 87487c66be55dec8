"""Queries over whole tables, held against SQL or plain Python without the cuts of the registered SQL."""

import math
import re

import pytest

from admira.operators import blocks
from admira import catalog
from admira.operators import pages as G
from admira.operators import rank as R
from admira.plans import ranking
from test_queries import TABLES, plain
from test_text import model_pack


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(spark, duck, sf_dir, name, sql):
    df, rel = catalog.queries()[name](spark, sf_dir), duck.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want and got


def without(name, *cuts):
    """The registered SQL without its cuts."""
    sql = catalog.oracle_sql()[name]
    for a, b in cuts:
        sql = sql.replace(a, b)
    return sql


COURSES = "s14_entity_view r3_score_program r8_score_goals r9_score_candidate r10_explain r12_recommend w4_rank_all a7_theme_counts a10_summary f1_explore".split()


@pytest.mark.parametrize("name", COURSES)
def test_courses_of_all_order_lines(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, name, without(name, (" WHERE l_orderkey % 100 = 0", "")))


def sentences(text):
    flat = re.sub(r"\s+", " ", text).strip(" ")
    return [x for x in re.split(r"(?<=[.!?])\s+", re.sub(r"(?<=[.!?])(?=[A-Z])", " ", flat)) if x]


def chunks(items, most=1200, overlap=150):
    units = []
    for x in items:
        x = x.strip(" ")
        units += sentences(x) if len(x) > most else [x] if x else []
    return model_pack(units, most, overlap)


def test_chunks_of_all_categories(spark, tmp_path):
    long = " ".join(f"Sentence {i} of a long line has some words." for i in range(70))
    texts = {1: "one short line", 2: "\n".join(f"line {i} " + "word " * (i % 40) for i in range(120)), 3: f"first\n\n{long}\nlast line", 4: ""}
    rows = [(k, t, "en", f"src {k}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes = {}, {}
    for k, t in texts.items():
        lines = [x for x in t.split("\n") if x]
        lists = {c: chunks(lines) for c in ("eligibility", "test_pattern", "scholarships")} | {"offered_courses": ["en"], "fee_structure": [f"fee: {k}"]}
        for c, made in lists.items():
            for i, x in enumerate(made):
                want[f"r{k}_{c}_{i}"] = (c, f"[University: src {k} | Category: {c}] {x}")
                sizes[f"r{k}_{c}_{i}"] = (f"src_{k}", len(x), f"src {k}", k % 2 == 0)
    assert "r2_eligibility_3" in want and "r3_scholarships_2" in want
    got = catalog.queries()["c4_build_chunks"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.chunk_id: (r.category, r.text) for r in got} == want
    got = catalog.queries()["c5_chunk_metadata"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.chunk_id: (r.university_id, r.length_chars, r.source_pages, r.is_public) for r in got} == sizes


def intents(text):
    """The rules in plain words, over the words that the query looks for."""
    t = (text or "").strip(" ")
    low, has = t.lower(), lambda p: bool(re.search(p, t, re.I))
    why = bool(re.search(r"\bwas\b.*\bwith\b|\bby\b.*\bbe\b", low))
    names = set(re.findall(r"\b(?:of the|this|with|the|was|and)\b", low))
    named = len({"w_the" if x in ("the", "of the") else "w_with" if x in ("with", "this") else x for x in names})
    focused = named >= 2 and (has(r"\b(as|at)\b") or "," in t)
    again, follow, chart = has(r"\b(this|from)\b"), has(r"\b(for|are)\b"), "of the" in low or "is to" in low
    followup = not focused and not (again and not follow) and (follow or why)
    question = t != "" and not chart and ("?" in t or has(r"\b(is|on)\b"))
    return focused, {"asks_why_ranked": why, "asks_rerank": again, "is_followup": followup, "is_question": question, "has_question_sign": has(r"\?|\bit\b|\bthat\b"), "asks_about_chart": chart}


def test_intents_of_every_message(spark, sf_dir):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    want = {k: intents(t) for k, t in texts.items()}
    for flag in want[next(iter(want))][1]:
        assert {w[1][flag] for w in want.values()} == {True, False}, flag
    got = {(r.conv_id, r.turn): r.asDict() for r in catalog.queries()["i4_message_intents"](spark, sf_dir).collect()}
    assert got == {(c, t): {"conv_id": c, "turn": t} | w[1] for (c, t), w in want.items()}
    routes = {}
    for (c, t), (focused, i) in want.items():
        ranked, locked = c % 2 == 0, c % 3 == 0
        answer = i["asks_about_chart"] or (ranked and (i["is_followup"] or i["is_question"])) or (locked and i["is_question"])
        routes[c, t] = "refine" if ranked and (focused or (i["asks_rerank"] and not i["is_followup"])) else "answer_question" if answer else "keep"
    assert set(routes.values()) == {"refine", "answer_question", "keep"}
    assert {(r.conv_id, r.turn): r.route for r in catalog.queries()["i6_route_turn"](spark, sf_dir).collect()} == routes


def test_every_line_is_aggregated(spark, sf_dir):
    first = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for i, line in enumerate(r.text.split("\n")):
            at = first.setdefault(r.source, {})
            at[line] = min(at.get(line, (r.doc_id, i)), (r.doc_id, i))
    want = {(s, n, x) for s, at in first.items() for n, x in enumerate(sorted(at, key=at.get), 1)}
    got = [(r.source, r.place, r.line) for r in catalog.queries()["a1_aggregate_pages"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_aggregated_lists_and_items(spark):
    rows = [(1, 5, ["b", "a"], ["x"]), (1, 300, ["c", "a"], []), (1, 900, ["b", "d"], ["x", "y"]), (2, 1, [], None)]
    df = spark.createDataFrame(rows, "k int, o int, a array<string>, b array<string>")
    got = {r.k: (r.a, r.b) for r in G.aggregate_pages(df, "k", "o", ["a", "b"]).collect()}
    assert got == {1: (["b", "a", "c", "d"], ["x", "y"]), 2: ([], [])}
    assert sorted(map(tuple, G.aggregate_items(df, "k", "o", "a", 2).collect())) == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, "d")]


_QUESTIONS = ("vec_id % 25 = 0 OR vec_id % 49 = 0", "vec_id % 20 = 0"), ("WHERE vec_id % 25 = 0", "WHERE vec_id % 20 = 0")


@pytest.mark.parametrize("name", ["w2_retrieve", "w3_topk_per_entity", "j3_attach_chunks", "j7_geocode"])
def test_questions_and_names_without_cuts(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, name, without(name, *_QUESTIONS, (" WHERE p_partkey % 7 = 0", ""), (" WHERE l_orderkey % 100 = 0", "")))


@pytest.mark.parametrize("rows", [200_000, 1])
def test_more_places_than_a_thousand(spark, duck, sf_dir, monkeypatch, rows):
    made = spark.range(3000).selectExpr("20 + id / 100.0D AS latitude", "60 + id / 200.0D AS longitude")
    monkeypatch.setattr(ranking, "entities", lambda spark, d: made)
    monkeypatch.setattr(blocks.bounded, "__defaults__", (rows,))
    one = catalog.queries()["p35_haversine"](spark, sf_dir).orderBy("profile_id").first()
    at = ranking.profiles(spark, sf_dir).where(f"profile_id = {one.profile_id}").first()
    rad = [(math.radians(20 + i / 100), math.radians(60 + i / 200)) for i in range(3000)]
    la, lo = math.radians(at.latitude), math.radians(at.longitude)
    km = [12742 * math.asin(math.sqrt(math.sin((a - la) / 2) ** 2 + math.cos(la) * math.cos(a) * math.sin((b - lo) / 2) ** 2)) for a, b in rad]
    assert (abs(one.far - max(km)) < 0.01) and (abs(one.near - min(km)) < 0.01)
