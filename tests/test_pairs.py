"""Phrases by automaton, gated pairs by bins and the bounded ranking, against plain Python and the ranking of all pairs."""

import random
import re

from pyspark.sql import functions as F

from admira.adapters import entities, profiles
from admira.operators import blocks, candidates
from admira.operators import intents as I
from admira.operators import phrases as P
from admira.operators import rank as R

WORDS = ["on", "one", "one two", "two", "two three", "é", "éon", "a b", "b c", "c", "c++", "x_y", "日本", "日"]


def brute_words(text, phrases):
    """An alternation of whole words, the longest first, as the regular expressions of Python read it."""
    border = lambda at: (at > 0 and re.match(r"\w", text[at - 1]) is not None) != (at < len(text) and re.match(r"\w", text[at]) is not None)
    out, at = [], 0
    while at < len(text):
        hit = next((p for p in sorted(phrases, key=lambda p: (-len(p), p)) if text.startswith(p, at) and border(at) and border(at + len(p))), None)
        if hit:
            out.append((at, hit))
        at += len(hit) if hit else 1
    return out


def test_phrases_against_plain_python(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice([*WORDS, " ", " ", ", ", "_"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(900, None), (901, ""), (902, "one two three"), (902, "one two three")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in [*WORDS, *WORDS, "", None]], "phrase string")
    for most in (100, 3):  # three phrases at a time: five blocks
        got = P.find(t, p, "words", most=most)
        assert sorted(map(tuple, got.distinct().collect())) == sorted({(i, s, w) for i, text in texts for s, w in brute_words(text or "", WORDS)})
        got = P.find(t, p, most=most).distinct()
        assert sorted(map(tuple, got.collect())) == sorted({(i, 0, w) for i, text in texts for w in WORDS if w in (text or "")})
    assert P.find(t, p.limit(0)).count() == 0 and P.find(t.limit(0), p, "words").count() == 0


def test_words_with_accents(spark):
    df = spark.createDataFrame([("éonç is it",), ("éonç it",), ("the éthe the.",)], "text string")
    flags = I.message_intents(F.col("text"), {"t": ["the"]}, I.INTENT_WORDS | {"question": r"(?i)\b(is|on)\b"})
    assert [r.q for r in df.select(flags["is_question"].alias("q")).collect()] == [True, False, False]
    assert [len(r.n) for r in df.select(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\bthe\b"), F.lit(0)).alias("n")).collect()] == [0, 0, 2]


def test_weights_follow_from_base_and_points():
    sets = R.weight_sets()
    assert list(sets["fees"].items()) == [("budget_fit", 30), ("program_match", 21), ("eligibility_match", 18), ("location_fit", 13), ("scholarship_fit", 9), ("goal_alignment", 9)]
    assert list(sets["distance"].items()) == [("location_fit", 25), ("program_match", 21), ("eligibility_match", 18), ("budget_fit", 18), ("scholarship_fit", 9), ("goal_alignment", 9)]
    other = R.factor_weights({"a": 50, "b": 30, "c": 20}, "c", 25)
    assert other == {"c": 45, "a": 34, "b": 21} and sum(other.values()) == 100


def test_gated_pairs_against_plain_python(spark):
    rng = random.Random(9)
    ps = [(i, rng.choice((None, -5.0, 0.0, 40.0, 59.9, 60.0, 99.5, 250.0)), rng.choice((None, True, False)), rng.choice((None, "", " North", "south", "West"))) for i in range(60)]
    es = [(i, rng.choice((None, -9.0, 0.0, 39.9, 60.0, 60.1, 120.0)), rng.choice((None, True, False)), rng.choice((None, " ", "north", "South "))) for i in range(50)]
    p = spark.createDataFrame(ps, "profile_id long, academic_percentage double, hostel_required boolean, preferred_province string")
    e = spark.createDataFrame(es, "id long, min_eligibility double, hostel boolean, province string")
    low = lambda v: (v or "").strip().lower()
    fits = lambda a, b: (a[1] is None or b[1] is None or a[1] >= b[1]) and (not a[2] or b[2] is not False) and (not low(a[3]) or not low(b[3]) or low(a[3]) == low(b[3]))
    want = sorted((a[0], b[0]) for a in ps for b in es if fits(a, b))
    for block in (4096, 5):
        met = candidates.gated(p.select(F.struct("*").alias("p")), e.select(F.struct("*").alias("e")), block)
        assert sorted((r.p.profile_id, r.e.id) for r in met.collect()) == want
    plan = R.gated_ids(p, e)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounded_ranking_equals_that_of_all_pairs(spark, sf_dir, monkeypatch):
    from pyspark.sql.window import Window as W

    p = profiles(spark, sf_dir)
    e = entities(spark, sf_dir)
    more = e.unionByName(e.select((F.col("id") + 1000).alias("id"), *[F.col(c) for c in e.columns if c not in ("id", "courses", "fee_amount", "min_eligibility")], F.array(F.lit("Rare GIZMO craft")).alias("courses"), (F.col("fee_amount") * 40).alias("fee_amount"), F.lit(95.0).alias("min_eligibility")))
    own = W.partitionBy("profile_id").orderBy(F.desc("total_score"), "id")
    every = R.totals(p, more)
    want = every.withColumn("rank", F.row_number().over(own)).where("rank <= 4").select("profile_id", "id", "total_score", "rank")
    want, n = sorted(map(tuple, want.collect())), every.count()
    for most in (blocks.BROADCAST_ROWS, 3):  # the second: nothing is sent whole
        monkeypatch.setattr(blocks.bounded, "__defaults__", (most,))
        best, seen = R.opened(*R.prepared(p, more), 4)
        assert sorted(map(tuple, best.select("profile_id", "id", "total_score", "rank").collect())) == want
    assert seen.agg(F.sum("opened")).first()[0] < n
    texts = R.factor_scores(R.candidate_pairs(p, e)).select("p.profile_id", "e.id", F.col("s_program_match.score").alias("m"), F.col("s_goal_alignment.score").alias("g"))
    shown = R.recommend(p, e, 4).select("profile_id", "id", F.filter("factors", lambda f: f["criterion"] == "program_match")[0]["score"].alias("m"), F.filter("factors", lambda f: f["criterion"] == "goal_alignment")[0]["score"].alias("g"))
    assert shown.exceptAll(texts).count() == 0


def test_geocode_against_plain_python(spark, monkeypatch):
    rng = random.Random(10)
    words = ["the", "north", "south", "town", "bay", "old", "x1"]
    name = lambda: " ".join(["the"] * (rng.random() < 0.6) + rng.sample(words[1:], rng.randint(0, 3)))
    places = [(i, rng.choice((name(), name().title(), " " + name(), "日本", None, "")), float(i), -float(i)) for i in range(120)]
    areas = [name() for _ in range(60)] + ["The", "日本", "", None, "nowhere", "town, old", "the", "the"]
    toks = lambda s: set(re.findall("[a-z0-9]+", s))
    want = {}
    for a in set(areas):
        k, found = (a or "").strip(" ").lower(), []
        for pos, p, la, lo in places:
            g = None if p is None else p.strip(" ").lower()
            held = g is not None and bool(toks(k)) and bool(toks(g)) and (toks(k) <= toks(g) or toks(g) <= toks(k))
            if a is not None and g is not None and (k == g or held):
                found.append((k != g, -len(toks(g)), pos, la, lo))
        want[a] = min(found)[3:] if found else (None, None)
    for most in (blocks.BROADCAST_ROWS, 1):
        monkeypatch.setattr(blocks.bounded, "__defaults__", (most,))
        got = R.geocode(spark.createDataFrame([(a,) for a in areas], "area string"), spark.createDataFrame(places, "pos long, place string, latitude double, longitude double"))
        assert {r.area: (r.latitude, r.longitude) for r in got.collect()} == want
    assert None in want and sum(v[0] is not None for v in want.values()) > 5


def test_spans_against_the_rule():
    import numpy as np

    from admira.operators.chunks import spans_of

    def model(sizes, most, overlap):
        out, now, n = [], [], 0
        for i, u in enumerate(sizes):
            if now and n + u > most:
                out.append((now[0], now[-1] + 1))
                kept = []
                while now and sum(sizes[j] for j in [now[-1], *kept]) <= overlap:
                    kept.insert(0, now.pop())
                now, n = kept, sum(sizes[j] for j in kept)
            now.append(i)
            n += u
        return out + ([(now[0], now[-1] + 1)] if now else [])

    rng = random.Random(14)
    for _ in range(2000):
        sizes, most, overlap = [rng.choice((1, 5, 20, 60, 200, 1300)) for _ in range(rng.randint(0, 25))], *rng.choice(((1200, 150), (30, 10), (10, 0), (20, 50)))
        assert list(zip(*spans_of(np.array(sizes, dtype=np.int64), most, overlap), strict=True)) == model(sizes, most, overlap)
    starts, ends = spans_of(np.full(2_000_000, 60), 1200, 150)  # a text of two million sentences
    assert len(starts) > 100_000 and ends[-1] == 2_000_000
