"""Text rules on own literals."""

from pyspark.sql import functions as F

from admira.functions import text as T
from admira.functions.geo import haversine_km, tokens, tokens_contained
from admira.functions.presence import is_present
from admira.operators import pages as G
from admira.operators import profiles as U
from admira.operators.chunks import chunk_items, chunk_text, pack_units


def one(spark, expr, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else (F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


def test_clean_text_takes_every_space(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a b c﻿ \n d ") == "a b c d"


def test_snippets_and_sentences(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="First one.Second one! Third?  ") == ["First one.", "Second one!", "Third?"]
    got = one(spark, T.keyword_snippets(F.col("t"), ["support"], 5), t="An air-supported hall stands here. Financial supports are given to many. Nothing else to say.")
    assert got == ["Financial supports are given to many."]


def test_noise(spark):
    assert one(spark, T.is_noise_page_text(F.col("t")), t="Copyright 2020 by someone in this place")
    assert one(spark, T.is_noise_page_text(F.col("t")), t="12345 67890 !!!")
    assert not one(spark, T.is_noise_page_text(F.col("t")), t="A plain sentence about nothing at all.")
    assert one(spark, T.is_noise_record_text(F.col("t")), t="short")


def test_percentages_and_ranges(spark):
    said = ["minimum 50% marks", "at least 60% in class", "Weightage of tests 90%"]
    assert one(spark, T.max_percentage(F.col("a")), a=said) == 60.0
    r = one(spark, T.numeric_range(F.col("t")), t="Rs 12,500 to PKR 30000")
    assert (int(r.amount_min), int(r.amount_max), r.currency) == (12500, 30000, "PKR")
    assert one(spark, T.numeric_range(F.col("t")), t="none") is None


def test_housing_is_tri_state(spark):
    f = T.tri_state_evidence(F.col("a"))
    assert one(spark, f, a=[]) is None
    assert one(spark, f, a=["The campus does not operate housing"]) is False
    assert one(spark, f, a=["It operates a dedicated hostel", "not available elsewhere"]) is True


def test_lists_keep_digits_at_the_ends(spark):
    assert one(spark, chunk_items(F.col("a")), a=[" 0 first 10 ", "1 second 11"]) == ["0 first 10 1 second 11"]


def test_slug_levels_join(spark):
    assert one(spark, T.entity_slug(F.col("t")), t=" Big - City/College ") == "big_city_college"
    assert one(spark, T.degree_levels(F.col("t")), t="BS and MS, Ph.D") == "PhD,Master,Bachelor"
    assert one(spark, T.natural_join(F.col("a")), a=["A", "", "B", "C"]) == "A, B, and C"
    assert one(spark, T.natural_join(F.col("a")), a=[]) == ""


def test_titles(spark):
    f = T.title_from_message(F.col("t"))
    assert one(spark, f, t="  ") == "New Chat"
    assert one(spark, f, t="Answer about X only. Do not recommend other universities. Why so?") == "Why so?"
    long = one(spark, f, t="word " * 40)
    assert len(long) <= 72 and long.endswith("…")


def test_fields_of_programmes(spark):
    f = T.program_to_field(F.col("t"))
    assert one(spark, f, t="Bachelor of Science (Civil Works)") == "Civil Works"
    assert one(spark, f, t="BS Computer Sciences") == "Computer Science"
    assert one(spark, f, t="Development Studies Development Studies") == "Development Studies"
    assert one(spark, f, t="Admission required") is None


def test_program_names(spark):
    ok = G.looks_like_program_name(F.col("t"))
    assert one(spark, ok, t="BS Civil Works")
    for bad in ("What is BS?", "(BS) x", "BS a, b, c, d", "Engineering", "merit list of BS"):
        assert not one(spark, ok, t=bad)
    assert one(spark, G.split_program_blocks(F.col("t")), t="4 years BS Alpha 2 years MS Beta") == ["BS Alpha", "MS Beta"]


def test_fee_tables(spark):
    schema = "content string, tables array<struct<headers array<string>, rows array<array<string>>>>"
    rows = [("", [(["Programme", "Admission Fee", "Tuition Fee"], [["BS Alpha", "100", "2,000"], ["", "x", ""]])]), ("The fee is Rs 500 for each course taken. Nothing more is asked.", [(["a", "b"], [["1", "2"]])])]
    got = [[tuple(f) for f in r.f] for r in spark.createDataFrame(rows, schema).select(G.extract_fees(F.col("content"), F.col("tables")).alias("f")).collect()]
    assert got[0] == [("BS Alpha", "Admission Fee: 100 | Tuition Fee: 2,000")]
    assert got[1] == [("fee_snippet", "The fee is Rs 500 for each course taken.")]


def test_programs_of_tables(spark):
    schema = "content string, tables array<struct<headers array<string>, rows array<array<string>>>>"
    row = [("", [(["Dept", "Offer"], [["Works", "4 years BS Alphabetics 2 years MS Beta Studies"], ["x", "25,000"]])])]
    got = spark.createDataFrame(row, schema).select(G.extract_programs(F.col("content"), F.col("tables")).alias("p")).first().p
    assert got == ["BS Alphabetics", "MS Beta Studies"]


def model_pack(units, most, overlap):
    """The rule in plain words: close a chunk before the unit that would overflow it, begin the next with what fits."""
    out, cur = [], []
    for u in units:
        if cur and sum(len(x) + 1 for x in cur) + len(u) + 1 > most:
            out.append(" ".join(cur))
            keep = 0
            while keep < len(cur) and sum(len(x) + 1 for x in cur[len(cur) - keep - 1 :]) <= overlap:
                keep += 1
            cur = cur[len(cur) - keep :] if keep else []
        cur = [*cur, u]
    return out + ([" ".join(cur)] if cur else [])


def test_pack_units_against_the_rule(spark):
    import random

    rng = random.Random(5)
    cases = [["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 25))] for _ in range(120)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u array<string>")
    got = {r.i: r.c for r in df.select("i", pack_units(F.col("u"), 40, 15).alias("c")).collect()}
    assert all(got[i] == model_pack(c, 40, 15) for i, c in enumerate(cases))
    assert one(spark, chunk_text(F.col("t")), t="") == []


def test_places(spark):
    assert abs(one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.19) < 0.01
    assert one(spark, tokens_contained(tokens(F.col("a")), tokens(F.col("b"))), a="North Town", b="town")
    assert not one(spark, tokens_contained(tokens(F.col("a")), tokens(F.col("b"))), a="", b="town")


def test_presence_and_stages(spark):
    assert one(spark, is_present(F.lit(0), "number")) and not one(spark, is_present(F.lit(0), "number", "falsy"))
    stage = U.education_stage(F.col("t"))
    assert one(spark, stage, t="grade 8, wants a BS") == 0
    assert one(spark, stage, t="completed BS in 2020") == 3
    assert one(spark, stage, t="nothing") is None
    assert one(spark, U.eligibility_block(F.lit("Master"), F.lit("A-Levels"))) is True
