"""Keyed state of streams and bucketed tables, against folds over the whole log."""

import random

from pyspark.sql import functions as F

from admira.sources import versioned
from admira.streaming import keyed as K
from admira.streaming import state as E


def run(spark, fold, parts, schema, base):
    """A stream over the parts, one batch each, in two runs of the same checkpoint."""
    half = len(parts) // 2
    for chunk in (parts[:half], parts[half:]):
        for i, rows in enumerate(chunk):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        K.stream_state(stream, fold, f"{base}/state", f"{base}/offsets", buckets=4).awaitTermination()
    return sorted(map(tuple, K.read_state(spark, fold, f"{base}/state").collect()), key=repr)


def dealt(rng, rows, n):
    """Rows in random order over n parts, some of them in two parts: late, repeated and replayed events."""
    parts = [[] for _ in range(n)]
    for r in rows:
        for p in rng.sample(range(n), rng.choice((1, 1, 2))):
            parts[p].append(r)
    for p in parts:
        rng.shuffle(p)
    return parts


def test_streamed_shortlist_equals_the_fold(spark, tmp_path):
    rng = random.Random(1)
    schema = "seq long, ts timestamp_ntz, student long, entity long, kind string"
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 3), rng.choice((1, 1, 1, 2, None)), rng.randint(0, 6), rng.choice(("save", "save", "unsave", None))) for i in range(240)]
    want = sorted(map(tuple, E.shortlist_state(spark.createDataFrame(rows, schema).where("student IS NOT NULL")).collect()), key=repr)
    assert want and run(spark, K.shortlist_fold(), dealt(rng, rows, 4), schema, str(tmp_path)) == want


def test_streamed_conversations_equal_the_fold(spark, tmp_path):
    rng = random.Random(2)
    import datetime as dt

    schema = "seq long, ts timestamp_ntz, conv long, kind string, title string, filter string"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), rng.randint(0, 9), rng.choice(("upsert", "rename", "delete", "touch", "touch")), rng.choice((None, " ", "t" * 200, " é")), rng.choice((None, "all"))) for i in range(150)]
    want = sorted(map(tuple, E.conversation_state(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert run(spark, K.conversation_fold(), dealt(rng, rows, 4), schema, str(tmp_path)) == want


def test_streamed_profiles_and_lists_equal_the_folds(spark, tmp_path):
    rng = random.Random(3)
    schema = "student long, seq long, kind string, name string, academic_percentage double"
    rows = [(rng.randint(0, 8), i, rng.choice(("save", "save", "delete")), rng.choice((None, "n", "m")), rng.choice((None, 50.0, 60.5))) for i in range(120)]
    log = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, E.profile_state(log, ["name", "academic_percentage"]).collect()), key=repr)
    assert run(spark, K.profile_fold("student long", "name string, academic_percentage double"), dealt(rng, rows, 2), schema, f"{tmp_path}/p") == want
    want = sorted(map(tuple, E.latest_by_key(log, "student", ["kind", "academic_percentage"]).collect()), key=repr)
    assert run(spark, K.latest_fold("student long", "kind string, academic_percentage double"), dealt(rng, rows, 2), schema, f"{tmp_path}/l") == want


def test_thinned_events_leave_the_same_state(spark):
    import pandas as pd

    fold, rng = K.shortlist_fold(), random.Random(4)
    for _ in range(100):
        f = pd.DataFrame({"profile_id": 1, "id": 2, "seq": rng.sample(range(30), 12)})
        f["us"], f["saved"] = f["seq"] * 10, [rng.random() < 0.6 for _ in range(12)]
        assert fold.merge(None, iter([fold.thin(f)])) == fold.merge(None, iter([f]))
        a, b = f.iloc[:6], f.iloc[6:]
        assert fold.merge(fold.merge(None, iter([b])), iter([a, b])) == fold.merge(None, iter([f]))


def test_commits_touch_their_buckets_only(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, v string, seq long"
    first = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(0).cast("long").alias("seq"))
    assert versioned.read(spark, path, schema).count() == 0
    assert versioned.upsert(first, path, ["k"], "seq", 0, buckets=16) == list(range(16))
    old = versioned.manifest(spark, path)
    reader = versioned.read(spark, path, schema, old)
    stamp = {b: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t/data/commit=0" / f"bucket={b}").iterdir()) for b in old}
    change = spark.createDataFrame([(3, "b", 1), (3, "late", -1), (500, "new", 1), (7, "older", -5)], schema)
    touched = versioned.upsert(change, path, ["k"], "seq", 1, buckets=16)
    assert 0 < len(touched) <= 3
    now = versioned.manifest(spark, path)
    assert {b for b in now if now[b] == 1} == set(touched) and all(now[b] == 0 for b in now if b not in touched)
    assert stamp == {b: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t/data/commit=0" / f"bucket={b}").iterdir()) for b in old}
    want = {k: ("a", 0) for k in range(200)} | {3: ("b", 1), 500: ("new", 1)}
    state = lambda: {r.k: (r.v, r.seq) for r in versioned.read(spark, path, schema).collect()}
    assert state() == want and reader.count() == 200 and reader.where("v <> 'a'").count() == 0
    versioned.upsert(change, path, ["k"], "seq", 1, buckets=16)  # the same commit again
    assert state() == want and versioned.manifest(spark, path) == now
    assert versioned.upsert(change.limit(0), path, ["k"], "seq", 2, buckets=16) == [] and state() == want


def test_keys_share_calls_of_the_state(spark, tmp_path, monkeypatch):
    """Many keys in few groups, two batches: late events and an absent key; calls follow the groups."""
    rng, big = random.Random(5), 1 << 40
    schema = "student long, seq long, kind string, entity long"
    rows = [(rng.choice((None,) * 9 + tuple(range(big, big + 300))), i, rng.choice(("a", None)), rng.choice((None, big + i))) for i in range(2000)]
    fold = K.last_values_fold("student long", "entity long", lambda df: df.select("student", "seq", "entity", F.col("kind").isNotNull().alias("has_entity")), lambda df: df)
    rng.shuffle(rows)
    for part in (rows[:1000], rows[1000:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = K.stream_state(stream, fold, f"{tmp_path}/state", f"{tmp_path}/offsets", buckets=2, groups=4)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 301
    want = {}
    for student, seq, kind, entity in sorted(rows, key=lambda r: r[1]):
        if kind is not None:
            want[student] = entity
    assert {r.student: r.entity for r in K.read_state(spark, fold, f"{tmp_path}/state").collect()} == want
