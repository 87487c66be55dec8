"""Turn repair, filter audit and sharding against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from admira.llm import filter_audit, sharding, turn_repair

TURNS = "conv_id long, turn long, role string, text string, place int, summary string, h int"
DOCS = "doc_id long, text string, lang string, source string, size int, h string, shard int, mask int, part string"
NAMES = {"u": "user", "a": "assistant"}


# 11 turn repair


def machine(state, initial):
    """The rule ``(s?(ua)+)?`` as states: '' at first, then the last initial."""
    return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 and initial != ""


def brute_edits(rows):
    """(cost, audit) by trying every way, the best way to each state kept after each row."""
    best = {"": (0, "")}

    def better(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def inserts(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                better(now, "a" if state == "u" else "u", (cost + 5, audit + "I"))

    for initial, fault in rows:
        inserts(best)
        after = {}
        for state, (cost, audit) in best.items():
            better(after, state, (cost + 2, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if machine(state, initial):
                    better(after, initial, (cost + more, audit + "K"))
                better(after, "a" if state == "u" else "u", (cost + more + 1, audit + "R"))
        best = after
    inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute_repair(rows, damage=True):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) from rows (conv, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        kept = own.setdefault(conv, [])
        name = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 9
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in own.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, coded, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            inked = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None
            seen.add((role, text))
            counts.update({fault: counts[fault] + 1} if fault else {})
            coded.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        turns = [r[0] for r in kept if r[0] is not None]
        cost, audit = brute_edits(coded)
        made, state, left = [], "", list(kept)
        for edit in audit:
            wanted = "a" if state == "u" else "u"
            role, text = (NAMES[wanted], "") if edit == "I" else left.pop(0)[1:]
            if edit != "D":
                made.append(f"{NAMES[wanted] if edit == 'R' else role}:{text}")
                state = made[-1][0]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_search_is_proved_and_its_bound_holds():
    rng = random.Random(11)
    for _ in range(1500):
        rows = [(rng.choice(("s", "u", "a", "x", "")), rng.choice((None, None, None, "truncated", "blank"))) for _ in range(rng.randint(0, 12))]
        coded = [(i, {None: turn_repair.FREE, "truncated": turn_repair.CUT}.get(f, turn_repair.GONE)) for i, f in rows]
        found = turn_repair.cheapest(coded)
        assert found == brute_edits(rows)
        assert turn_repair._suffix_bound(coded, turn_repair._ENDS)(0, turn_repair.START) <= found[0]


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def test_repair_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["Yes.", "No!", "so", "", " \t", None, "é?", "a\nb.", "Yes. \n", "long " * 400]
    rows = []
    for conv in range(120):
        rows += [(conv, rng.choice((None, *range(6))), rng.choice(("user", "assistant", "system", "Tool", "", None)), rng.choice(texts)) for _ in range(rng.randint(1, 9))]
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Ho."), (500, None, "system", None), (501, -4, "assistant", "a.")]
    for block in (64, 3):  # with three rows a block, most conversations are put together from several
        monkeypatch.setattr(turn_repair, "BLOCK", block)
        got = turn_repair.repaired_digest(given(spark, rows))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute_repair(rows)


def test_repair_of_a_long_conversation_and_of_none(spark):
    rng = random.Random(13)
    rows = [(7, t, rng.choice(("user", "assistant")), f"{rng.randint(0, 900)}{rng.choice(('.', '.', ''))}") for t in range(1500)]
    want = brute_repair(rows, damage=False)
    got = turn_repair.digest(given(spark, rows)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    turns = turn_repair.repair(given(spark, rows)).orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == want[7][-1]
    assert "".join(r.edit for r in turns) == want[7][-2].replace("D", "")
    assert turn_repair.repaired_digest(given(spark, [])).count() == 0
    lost = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert [tuple(r) for r in turn_repair.repaired_digest(given(spark, [(9, lost, "user", "Hi.")])).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_on_the_given_table(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = brute_repair([tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()])
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.repaired_digest(c).collect()} == want


# 12 filter audit


def brute_audit(docs, labels):
    """Rows of the audit from docs (id, text, lang) and labels (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        parts.setdefault(lang or "", []).append(({f for f in "ABCDE" if fails[f]}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        made = []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                made.append((f, [part, order, step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]))
        for f, row in made:
            out.append((*row, sum(r[4] for g, r in made if g == f)))
    return sorted(out)


def audit_frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "s", 1, "h", 3, 4, "p") for i, t, lang in docs], DOCS)
    return d, spark.createDataFrame([(*row, "part") for row in labels], "doc_id long, quality int, toxic int, part string")


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    long = [" ".join(f"w{rng.randint(0, n)}" for _ in range(260)) for n in (50, 100, 5000)]
    texts = [None, "", "  ", "plain", "SHOUT a", "a $ b", "A|B", long[0], long[1], long[2], long[2] + " &", "É " * 300, "x y z", "Z" * 5000, long[1]]
    docs = [(i if i % 9 else None, rng.choice(texts), rng.choice(("en", "de", "", None))) for i in range(150)]
    docs += [(3, "twice", "en"), (3, "twice", "en"), (4, "twice", "en"), (2, "twice", None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    want = brute_audit(docs, labels)
    got = filter_audit.audit(*audit_frames(spark, docs, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == want
    whole = [filter_audit.text_mask((t or "").encode()) for t in texts]
    monkeypatch.setattr(filter_audit, "WINDOW", 7)  # a text in many windows, words longer than one
    assert [filter_audit.text_mask((t or "").encode()) for t in texts] == whole
    assert len(want) == 3 * 600
    assert filter_audit.audit(*audit_frames(spark, [], [])).count() == 0


def test_ranks_and_intervals():
    orders = list(permutations(range(4)))
    assert [filter_audit.rank_of(o, 4) for o in orders] == list(range(24))
    spans = filter_audit.removal_intervals(4)
    for mask in range(1, 16):
        hit = sorted((r, step) for m, step, a, b in spans if m == mask for r in range(a, b))
        assert hit == [(r, next(s for s, j in enumerate(o, 1) if mask >> j & 1)) for r, o in enumerate(orders)]


def test_windows_join_to_the_text():
    for raw in (b"", b"one", b"a  b\tc\n" * 400000, b"x" * 3_000_000, b"x" * 1_500_000 + b" y " * 400_000):
        pieces = list(filter_audit._windows(raw))
        assert b"".join(pieces) == raw and sum(len(p.split()) for p in pieces) == len(raw.split())


# 13 sharding


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.assign(docs, [1.0] * 16, [1.0] * 17).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) == len({r.doc_id for r in rows})
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert 0 < sum(r.grown_shard == 16 for r in rows) < len(rows) / 5


def test_shares_follow_weights_and_few_records_move(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    of = lambda w: {r.doc_id: r.shard for r in sharding.assign(ids, w).collect()}
    weights = [1.0, 2.0, 0.0, 5.0]
    before, more, fewer = of(weights), of([*weights, 2.0]), of([1.0, 2.0])
    for j, w in enumerate(weights):
        assert abs(sum(s == j for s in before.values()) - 40_000 * w / 8) < 500
    assert all(more[i] in (s, 4) for i, s in before.items()) and abs(sum(s == 4 for s in more.values()) - 8000) < 500
    assert all(fewer[i] == s for i, s in before.items() if s < 2)


def test_shard_edges(spark):
    docs = [(1, None), (1, None), (1, "a"), (None, "é"), (None, None), (-5, ""), (10**15, "x" * 100_000)]
    d = spark.createDataFrame([(i, t, None, None, 1, "h", 2, 3, "p") for i, t in docs], DOCS)
    rows = sharding.assign(d, [1.0] * 3).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    for i in {i for i, _ in docs}:
        assert len({r.shard for r in rows if r.doc_id == i}) == 1
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard is None for r in rows) and sharding.assign(d.limit(0), [1.0]).count() == 0
    text = d.withColumn("doc_id", F.col("doc_id").cast("string"))  # the same key as text
    assert {(str(r.doc_id), r.shard) for r in rows} == {(str(r.doc_id), r.shard) for r in sharding.assign(text, [1.0] * 3).collect()}
    for bad in ([], [0.0], [-1.0, 2.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.assign(d, bad)
