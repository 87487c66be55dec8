"""The pipeline operators against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from admira.llm import best_fit, chat_windows, encode, gif_media, language_id, line_dedup, lm_scoring, mixing, multi_index, ngram_join, queries, range_coder, shingles, token_files
from admira.llm.encode import Encoder
from admira.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, size int, h string"
VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi"]


def frame(spark, texts, **more):
    """Documents with clashing extra columns; texts may be (id, text)."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, more.get("lang", {}).get(i), more.get("source", {}).get(i), 7, "h") for i, t in rows], DOCS)


def edge_texts():
    return [None, "", " ", "one", "one two", "\n\n\n", "x" * 5000, "a b c d e", "a b c d e", "é 日本 😀 \x00 <|endoftext|>", "w " * 3000]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# 1 line dedup


def brute_lines(rows, window=3):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[1] is not None)):
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out | {i: None for i, t in rows if t is None}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(40)] + edge_texts() + ["a\na\na\na\na\nb"]
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(frame(spark, rows), counts=True)
    assert got.columns == [*frame(spark, []).columns, "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    twice = line_dedup.dedup_lines(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted((r.text for r in twice), key=len) == ["", "a\nb\nc", "a\nb\nc"]


# 2 GIF


def test_gif_round_trip(spark):
    rng = random.Random(2)
    for n in (0, 1, 64, 4000, 70000):
        for k in (2, 4, 256):
            data = bytes(rng.randrange(k) for _ in range(n))
            assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, n) == data
    docs = frame(spark, edge_texts())
    got = {r.doc_id: r for r in gif_media.read_texts(gif_media.store_texts(docs)).collect()}
    for i, t in enumerate(edge_texts()):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7][1:] == got[8][1:]
    assert gif_media.read_texts(gif_media.store_texts(frame(spark, []))).count() == 0


def test_gif_rules(spark):
    """Frames with own palettes, transparency, disposal and interlacing, put together by hand."""

    def frame_of(pixels, left, top, w, h, disposal, transparent=None, delay=5, interlaced=False, bits=2):
        packed = disposal << 2 | (transparent is not None)
        head = b"\x21\xf9\x04" + bytes([packed, delay, 0, transparent or 0]) + b"\0"
        return head + b"\x2c" + np.array([left, top, w, h], "<u2").tobytes() + bytes([0x40 * interlaced, bits]) + gif_media._blocks(gif_media.lzw_encode(bytes(pixels), bits))

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = b"GIF89a" + np.array([2, 2], "<u2").tobytes() + bytes([0x81, 0, 0]) + palette
    data += frame_of([1, 1, 1, 1], 0, 0, 2, 2, 1) + frame_of([2, 3], 0, 0, 2, 1, 2, transparent=3) + frame_of([3], 1, 1, 1, 1, 3) + frame_of([2], 0, 1, 1, 1, 1) + b"\x3b"
    shown = [f[7].copy() for f in gif_media.decode_gif(data)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown[0].tolist() == [[red, red], [red, red]]
    assert shown[1].tolist() == [[green, red], [red, red]]
    assert shown[2].tolist() == [[none, none], [red, blue]]
    assert shown[3].tolist() == [[none, none], [green, red]]
    high = b"GIF89a" + np.array([1, 9], "<u2").tobytes() + bytes([0x81, 0, 0]) + palette + frame_of([0, 1, 2, 3, 0, 1, 2, 3, 0], 0, 0, 1, 9, 0, interlaced=True) + b"\x3b"
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    got = next(gif_media.decode_gif(high))[7][:, 0, :3]
    assert [list(got[y]) for y in order] == [list(palette[3 * c : 3 * c + 3]) for c in (0, 1, 2, 3, 0, 1, 2, 3, 0)]
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"nonsense")), (3, None), (4, bytearray(data[:40]))], "k int, media binary")
    rows = gif_media.decode_gifs(files, "k").collect()
    assert [(r.frame, r.delay_ms) for r in rows if r.k == 1] == [(0, 50), (1, 50), (2, 50), (3, 50)]
    assert all(r.error for r in rows if r.k in (2, 4)) and not [r for r in rows if r.k == 3]
    assert sum(rows[0].histogram) == 4


def test_gif_headers_and_many_frames(spark):
    """A header that asks for 17 GB, a frame beyond its screen, a wrong code size; and good frames before a bad one."""
    head = lambda w, h: b"GIF89a" + np.array([w, h], "<u2").tobytes() + bytes([0x80, 0, 0]) + bytes(6)
    place = lambda w, h: b"\x2c" + np.array([0, 0, w, h], "<u2").tobytes() + b"\0"
    one = place(1, 1) + b"\x02" + gif_media._blocks(gif_media.lzw_encode(b"\1", 2))
    files = [(1, head(65535, 65535) + one), (2, head(4, 4) + place(60000, 60000) + b"\x02\0"), (3, head(1, 1) + place(1, 1) + b"\x20\x01\0\0"), (4, head(1, 1) + 500 * one + b"\x2c"), (5, head(1, 1) + 3 * one + b"\x3b"), (6, head(1, 1))]
    rows = gif_media.decode_gifs(spark.createDataFrame([(k, bytearray(b)) for k, b in files], "k int, media binary"), "k").collect()
    by = {k: [r for r in rows if r.k == k] for k, _ in files}
    assert all(len(by[k]) == 1 and by[k][0].error for k in (1, 2, 3, 6))
    assert len(by[4]) == 501 and by[4][-1].error and by[4][-1].frame == 500 and not any(r.error for r in by[4][:-1])
    assert [r.frame for r in by[5]] == [0, 1, 2] and not any(r.error for r in by[5])


def test_code_widths_are_made_once(monkeypatch):
    """They were made anew for every file. Random samples fill the table, equal ones name the entry in the making."""
    rng = random.Random(2)
    for data in (b"", b"x", bytes(9000), b"ab" * 3000, rng.randbytes(9000)):
        stream = gif_media.lzw_encode(data)
        with monkeypatch.context() as m:
            m.setattr(gif_media, "_widths", None)
            assert gif_media.lzw_encode(data) == stream and gif_media.lzw_decode(stream, 8, len(data)) == data


# 3 and 4 tokens


def plain_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    model.encode_special_tokens = True
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library():
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "1", ".", " ", " ", "　", "“", "日", "<|endoftext|>", " \n", "İ", "\x00", "😀"]
    encoder = Encoder(queries.tokenizer_path())
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(100)]
        assert [x.tolist() for x in encoder.encode(texts)] == plain_ids(texts)


def test_encoder_cuts_at_marks_and_lines():
    rng = random.Random(5)
    parts = ["Ab", "é", "ä", "×", "÷", "ª", "1", ".", ",", "-", "'", "'s", "'re", "\n", "\n", "\r\n", "\t", " ", " ", " ", "\u00a0", "\u0301", "日", "ü.", "\nÜb", ".\nTh", "<|endoftext|>"]
    encoder = Encoder(queries.tokenizer_path())
    for size in (3, 6, 40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(1500)]
        assert [x.tolist() for x in encoder.encode(texts)] == plain_ids(texts)
    encoder = Encoder(queries.tokenizer_path())
    texts = [" ".join(w + m for w in ("alpha", "größe", "Rot", "done") for m in ",.;:!?")]
    assert [x.tolist() for x in encoder.encode(texts)] == plain_ids(texts)
    assert len(encoder.known) < 15  # a word is one piece, whatever mark comes after it


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_whose_polynomials_are_equal():
    """A Thue-Morse word and its complement are one to every polynomial hash modulo a power of two."""
    coder = Encoder(queries.tokenizer_path())
    for n in (1024, 2048):
        w, v = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        texts = [w, v, f"x {w}", f"x {v}"]
        assert [x.tolist() for x in coder.encode(texts)] == plain_ids(texts)
        first, second = shingle_sets([w.encode(), v.encode()], 3)
        assert first[0] != second[0]


def test_encoder_compares_bytes_where_keys_clash(monkeypatch):
    monkeypatch.setattr(encode, "hashes_of", lambda first, further, more, size: np.full(len(first), 7 << 20, dtype=np.uint64))
    coder = Encoder(queries.tokenizer_path())
    texts = ["hello abcdefghij abcdefghik done", "abcdefghik x", "y abcdefghijklmnopqrs z abcdefghijklmnopqrt", "short words only", "abcdefgh"]
    for order in (1, -1):
        assert [x.tolist() for x in coder.encode(texts[::order])] == plain_ids(texts[::order])


def test_encoder_windows(monkeypatch):
    monkeypatch.setattr(encode, "WINDOW", 5)
    texts = ["a b c d e f g h i", "", "word " * 30 + "end", " lead", "x"]
    assert [x.tolist() for x in Encoder(queries.tokenizer_path()).encode(texts)] == plain_ids(texts)


def test_word_windows(monkeypatch):
    texts = [b"Ab c  dd\teee", b"", b"x" * 40 + b" y", b"  ", b"q w e r t y u i o p"]
    hashes, counts = shingles.words(texts)
    monkeypatch.setattr(shingles, "WINDOW", 7)
    again, same = shingles.words(texts)
    assert hashes.tolist() == again.tolist() and counts.tolist() == same.tolist() == [4, 0, 2, 0, 10]


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    bins, offsets = best_fit.best_fit(lengths, 64)
    room: dict[int, int] = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        fitting = [r for r in room.values() if r >= n]
        assert room.get(b, 64) == (min(fitting) if fitting else 64) and o == 64 - room.get(b, 64)
        room[b] = room.get(b, 64) - n
    assert len(room) <= 1.05 * sum(lengths) / 64 + 1


def test_packing(spark, corpus):
    docs = corpus.select("doc_id", "text").union(frame(spark, [(-1, None), (-2, ""), (-3, "a"), (-3, "a")]).select("doc_id", "text"))
    rows = best_fit.pack(docs, queries.tokenizer_path()).collect()
    source = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(source, plain_ids(source.values()), strict=True))
    by_seq, by_doc = {}, {}
    for r in rows:
        part = [*ids[r.doc_id], 2][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    for d, parts in by_doc.items():
        if d == -3:
            continue
        assert [p for p, _, _ in sorted(parts)] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(ids[d]) + 1
        assert all(n == 1024 for _, _, n in sorted(parts)[1:])
    total = sum(n for parts in by_seq.values() for _, n in parts)
    assert len(by_seq) <= total / 1024 * 1.01 + 2
    assert best_fit.pack(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_range_coder():
    rng = np.random.default_rng(4)
    cases = [[], [5], rng.integers(0, 65536, 5000), [65535] * 5000, np.arange(9000) % 7, [0] * 2048 + [65535] * 2049]
    cases += [rng.zipf(1.3, n) % 50000 for n in (1, 2, 2047, 2048, 2049, 4097)] + [np.repeat(rng.integers(0, 65536, 30), 2000)]
    for case in cases:
        ids = np.array(case, dtype=np.int64)
        data = range_coder.encode(ids)
        assert np.array_equal(range_coder.decode(data), ids)
    assert len(range_coder.encode(np.arange(9000) % 7)) < 9000 / 4
    broken = bytearray(range_coder.encode(np.arange(5000)))
    broken[-20] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([65536]))


def test_range_coder_carries():
    """Intervals at the upper end of the scale, whose low ends carry often, and through words of ones."""
    rng = np.random.default_rng(11)
    for n in (3000, 30000):
        ids = np.where(rng.random(n) < 0.02, rng.integers(0, 65536, n), 65535 - (rng.random(n) < 0.3))
        data = range_coder.encode(ids)
        assert np.array_equal(range_coder.decode(data), ids)


def test_range_coder_beats_zlib_on_real_ids(corpus):
    coder = Encoder(queries.tokenizer_path())
    ids = np.concatenate([np.append(x, 0) for x in coder.encode([r.text or "" for r in corpus.orderBy("doc_id").collect()])]).astype(np.int64)
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids)
    assert len(data) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_token_files(spark, corpus, tmp_path):
    docs = corpus.select("doc_id", "text").union(frame(spark, [(-5, None), (-4, "")]).select("doc_id", "text"))
    token_files.write(docs, f"{tmp_path}/t", queries.tokenizer_path())
    got = {r.doc_id: r for r in token_files.read(spark, f"{tmp_path}/t").collect()}
    at, source = 0, sorted((r.doc_id, r.text) for r in docs.collect())
    for (d, _), ids in zip(source, plain_ids(t for _, t in source), strict=True):
        ids = np.array([*ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write(frame(spark, []), f"{tmp_path}/e", queries.tokenizer_path())
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_token_files_have_no_small_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for i, sizes in enumerate(([300] * 7, [1400, 9000, 600], [5000], [999, 1, 1])):
            token_files.write(frame(spark, [(d, " a" * n) for d, n in enumerate(sizes)]).select("doc_id", "text"), f"{tmp_path}/{i}", queries.tokenizer_path())
            got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.read(spark, f"{tmp_path}/{i}").orderBy("doc_id").collect()]
            assert got == [(d, sum(sizes[:d]) + d, n + 1) for d, n in enumerate(sizes)]
            assert all(r.n_ids >= 500 for r in spark.read.parquet(f"{tmp_path}/{i}").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# 5 chat windows


def test_chat_windows(spark, sf_dir):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "to\nol\\"]) if t else rng.choice(["system", "user"]), rng.choice(["", None, "[INST]", "\\", "<\\/s></s>", "[ANS] x\n" * 3, "word " * rng.randint(1, 300)])) for c in range(30) for t in range(rng.randint(1, 30))]
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "a"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    made = chat_windows.windows(df, budget=200, history_tokens=40)
    got = {r.conv_id: r for r in chat_windows.digest(made).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in convs.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        target = "".join(x for _, _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    for w in made.collect():
        assert w.n_new == 1 or w.window == 0 or len(w.formatted) < 4 * 200 + 2500
    assert max(r.n_windows for r in got.values()) > 3
    assert chat_windows.digest(chat_windows.windows(df.limit(0))).count() == 0


def brute_windows(turns, budget, history_turns, history_tokens):
    """(window, turns repeated, turns of its own, positions under the mask) of a conversation [(role, text)]."""
    tok = [-(-len(x.encode()) // 4) + 1 for _, x in turns]
    system = turns[0][0] == "system"
    room = budget - history_tokens - (tok[0] if system else 0)
    starts, held = [], 0
    for i, n in enumerate(tok):
        if i == 0 or held + n > (budget if starts[-1] == 0 else room):
            starts.append(i)
            held = 0
        held += n
    out = []
    for s, e in zip(starts, [*starts[1:], len(turns)], strict=True):
        past = [j for j in range(max(0, s - history_turns), s) if not (j == 0 and system) and sum(tok[j:s]) <= history_tokens]
        context = ([0] if s and system else []) + past
        out.append((s, [turns[j] for j in context], turns[s:e]))
    return out


def windows_of(spark, convs, **more):
    df = spark.createDataFrame([(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat_windows.windows(df, **more)
    read = made.select("conv_id", "window", "n_context", "n_new", "loss", "formatted", chat_windows.read_turns(F.col("formatted")).alias("turns"), chat_windows.learned(F.col("formatted"), F.col("loss")).alias("learned"))
    got = {}
    for r in read.collect():
        turns = [(t.role, t.text) for t in r.turns]
        got.setdefault(r.conv_id, []).append((r.window, turns[: r.n_context], turns[r.n_context :]))
        assert r.learned == [x for role, x in turns[r.n_context :] if role == "assistant"] and len(turns) == r.n_context + r.n_new
    return {c: sorted(w) for c, w in got.items()}


def test_chat_windows_against_plain_python(spark):
    rng = random.Random(55)
    convs = {c: [(("system" if c % 2 and t == 0 else rng.choice(["user", "assistant"])), "x" * rng.choice([0, 3, 40, 90, 400, 900]) + "[/INST]") for t in range(rng.randint(1, 40))] for c in range(12)}
    assert windows_of(spark, convs, budget=200, history_turns=2, history_tokens=60) == {c: brute_windows(t, 200, 2, 60) for c, t in convs.items()}


@pytest.mark.parametrize(("budget", "history_turns", "history_tokens", "fan"), [(12, 2, 3, 2), (12, 30, 40, 3), (7, 0, 0, 64)])
def test_spans_cross_blocks(spark, monkeypatch, budget, history_turns, history_tokens, fan):
    """Conversations of many blocks, three levels of tables and more; a room below zero leaves every turn alone."""
    monkeypatch.setattr(chat_windows, "FAN", fan)
    rng = random.Random(56)
    one = lambda n, first: [((first if t == 0 else rng.choice(["user", "assistant"])), "x" * rng.choice([0, 0, 1, 4, 9, 60])) for t in range(n)]
    convs = {c: one(n, "system" if c % 2 else "user") for c, n in enumerate([1, budget - 1, budget, budget + 1, 2 * budget, 100, 199])}
    assert windows_of(spark, convs, budget=budget, history_turns=history_turns, history_tokens=history_tokens) == {c: brute_windows(t, budget, history_turns, history_tokens) for c, t in convs.items()}


def test_short_turns_fill_the_budget(spark):
    got = windows_of(spark, {1: [("user", "x")] * 300})[1]
    assert [len(new) for _, _, new in got] == [256, 44]


def test_long_conversation(spark):
    n = 3000
    df = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 130)).alias("text"))
    r = chat_windows.digest(chat_windows.windows(df)).first()
    target = "".join(f"{i}{' word' * 130}" for i in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(target), hashlib.sha256(target.encode()).hexdigest())


# 6 scores


def brute_scores(docs, order, backoff=0.4, by_others=False):
    c, d = Counter(), Counter()
    marked = [["^", *x] if x else [] for x in docs]
    for y in marked:
        grams = [tuple(y[i : i + k]) for k in (1, 2, 3) for i in range(len(y) - k + 1)]
        c.update(grams)
        d.update(set(grams))
    out = []
    for y in marked:
        total = 0.0
        for i in range(1, len(y)):
            grams = [(k, tuple(y[i - k + 1 : i + 1])) for k in range(order, 1, -1) if i - k + 1 >= 0]
            k, g = next(((k, g) for k, g in grams if d[g] > by_others), (1, (y[i],)))
            total += np.log(backoff ** (order - k) * c[g] / (c[g[:-1]] if k > 1 else sum(map(len, docs))))
        out.append(total)
    return out


@pytest.mark.parametrize(("top", "hot", "order"), [(1 << 20, 8, 2), (1 << 20, 8, 3), (6, 2, 3), (4, 1, 2), (4, 1, 3), (3, 100, 3)])
def test_lm_scores_against_counts(spark, monkeypatch, top, hot, order):
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", top)
    monkeypatch.setattr(lm_scoring, "HOT_IN_SLICE", hot)
    rng = random.Random(6)
    texts = ["a b a b c", "a b", None, "", "A B d", "e", "a b a b c", "q r s t", "q r s t u"] + [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    for by_others in (False, True):
        got = {r.doc_id: r for r in lm_scoring.score(frame(spark, texts), order=order, by_others=by_others).collect()}
        for i, want in enumerate(brute_scores(docs, order, by_others=by_others)):
            assert got[i].n_words == len(docs[i])
            assert got[i].log_score is None if not docs[i] else abs(got[i].log_score - want) < 1e-3
    assert lm_scoring.score(frame(spark, [])).count() == 0
    same = lm_scoring.score(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]), order=2).collect()
    assert sorted((str(r.doc_id), r.n_words, r.log_score) for r in same) == [("1", 2, 0.0), ("1", 2, 0.0), ("2", 0, None), ("None", 2, 0.0)]


def test_own_ngrams_count(spark):
    got = {r.doc_id: r.log_score for r in lm_scoring.score(frame(spark, ["a b " * 50, "c d", "c d"])).collect()}
    assert abs(got[0] - brute_scores([["a", "b"] * 50, ["c", "d"], ["c", "d"]], 2)[0]) < 1e-3 and round(got[0], 1) == -2.1


def test_own_ngrams_move_without_their_parts(spark, monkeypatch):
    """Bigrams with a rare word were moved with both words and joined with the rare words' counts, which grew faster than the table."""
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 3)
    scored = lm_scoring.score(frame(spark, ["a b c d", "c d a b", "b a d e e", "e f f"]))
    plan = scored._jdf.queryExecution().toString()
    assert "Join" not in plan and len(set(re.findall(r"\[g#\d+L?, a#\d+L?, t#\d+L?\]", plan))) > 0
    docs = ["abcd", "cdab", "badee", "eff"]
    assert all(abs(r.log_score - brute_scores(docs, 2)[r.doc_id]) < 1e-3 for r in scored.collect())


# 7 languages


def test_language_id(spark, corpus):
    got = language_id.identify(corpus).join(corpus.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held.n > 10 and held.a > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0
    model = language_id.train(corpus)
    odd = language_id.predict(frame(spark, edge_texts() + ["123 !?"]), model)
    und = {r.doc_id for r in odd.where("lang_pred = 'und'").collect()}
    assert und == {0, 1, 2, 5, 11}
    none = language_id.identify(frame(spark, ["text", None])).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0
    kept = language_id.keep_language(corpus)
    assert kept.columns == corpus.columns and kept.count() >= 0.97 * corpus.where("text IS NOT NULL").count()


def test_decision_against_exact_sets():
    rng = random.Random(71)
    vocab = {f"l{i}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(40)] for i in range(70)}  # two words of bits
    of = {name: np.unique(language_id.grams([" ".join(ws)])[0]) for name, ws in vocab.items()}
    langs, table = language_id.bit_filter(of)
    fill = [np.count_nonzero(table[:, i // language_id.WORD_BITS] >> np.uint64(i % language_id.WORD_BITS) & np.uint64(1)) / language_id.POSITIONS for i in range(len(langs))]
    texts = [" ".join(rng.choice(vocab[f"l{rng.randrange(70)}"] if rng.random() < 0.3 else vocab[name]) for _ in range(30)) for name in vocab] + ["", "12 ?", "zzzz"]
    names, scores = language_id._judge(texts, langs, table, np.array([f**language_id.HASHES for f in fill]))
    for text, name, score in zip(texts, names, scores, strict=True):
        g = language_id.grams([text])[0]
        share = {x: float(np.isin(g, of[x]).mean()) if len(g) else 0.0 for x in langs}
        best = max(share.values())
        assert name == ("und" if not any(map(str.isalpha, text)) else name) and abs(score - best) < 0.01
        if len(g) and best > 0.05:
            assert share[name] >= best - 0.01


def test_many_labels(spark, monkeypatch):
    rng = random.Random(72)
    vocab = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(260)}
    rows = [(i * 260 + j, " ".join(rng.choice(ws) for _ in range(30)), name) for i in range(2) for j, (name, ws) in enumerate(vocab.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model[0] == sorted(vocab)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) > 0.97 * len(rows)
    monkeypatch.setattr(language_id, "LANGUAGES", 259)
    with pytest.raises(ValueError):
        language_id.train(docs)


def test_languages_are_learned_from_every_row(spark, monkeypatch):
    """About 2000 documents of a language were learned from, and gave its cut; counts are exact however they are added up."""
    monkeypatch.setattr(language_id, "COUNTS", 50)
    monkeypatch.setattr(language_id, "TOP", 1 << 20)
    names = ["".join(chr(97 + (i // 26**j) % 26) for j in range(4)) for i in range(6000)]
    rows = [(i, f"q{x} q{x}", "xx") for i, x in enumerate(names)] + [(9000 + i, "zzz yyy", "yy") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = language_id.tops(docs)
    want, _ = language_id.grams([f"q{x} q{x}" for x in names])
    assert set(found) == {"xx", "yy"} and set(found["xx"].tolist()) == set(want.tolist())
    model = language_id.bit_filter(found)
    scores = sorted(r.score for r in language_id.predict(docs, model).where("lang_pred = 'xx'").collect())
    low = language_id.cuts(docs, model, 9.0)["xx"] * 2
    at = scores[-(-len(scores) // 100) - 1]
    assert at - 1 / language_id.STEPS <= low <= at


def test_grams_equal_windows():
    texts = ["Ab c", "", "x", "é--É 12 z", "ab"]
    g, n = language_id.grams(texts, 3)
    want = []
    for t in texts:
        padded = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        padded = re.sub(" +", " ", padded)
        want += [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]
    assert sorted("".join(chr(int(x) >> s & (1 << 21) - 1) for s in (42, 21, 0)) for x in g) == sorted(want)
    assert n.sum() == len(g)


# 8 nearest neighbours


def test_heap_walk_is_in_order():
    rng = np.random.default_rng(8)
    d1, d2, counts = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    cells = multi_index.visited_cells(d1, d2, counts, 10**9)
    assert len(cells) == np.count_nonzero(counts)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums)


def test_search_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[100:140] = x[50]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] * 16), (7150, [1.0, 2.0]), (7200, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("a", F.lit("clash"))
    got: dict[int, list] = {}
    for r in multi_index.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(6000), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
        assert len(got[q]) == 5 and q not in {v for v, _ in got[q]}
        assert all(abs(sc - u[v] @ u[q]) < 1e-12 for v, sc in got[q])
    assert hits / (5 * 120) >= 0.9 and set(got) == set(range(0, 6000, 50))
    assert [v for v, _ in got[50]] == [100, 101, 102, 103, 104]
    few = multi_index.search(df.where("vec_id IN (0, 1, 7050)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert multi_index.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_ties_of_parallel_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=24).astype(np.float32).astype(float)
    rows = [(0, (base + 0.1).tolist())] + [(i, (base * n).tolist()) for i, n in ((9, 1.0), (7, 3.0), (5, 7.0), (3, 0.5), (4, 11.0), (8, -1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 4, 5, 7, 9] and len({r.score for r in got}) == 1


def test_rarer_lengths_are_compared_exactly(spark, monkeypatch):
    """Each length by itself, over several blocks, against brute force; ties and repeated directions go to smaller ids."""
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(9)
    made = {i: rng.normal(size=(8 if i % 2 else 3 + i % 3)).tolist() for i in range(400)}
    made |= {i + 402: [x * 4 for x in made[i]] for i in range(0, 120, 6)}  # multiples tie exactly
    rows = [*made.items(), (1000, [1.0]), (1050, [2.0, 1.0]), (1100, None), (1101, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    valid = {i: np.array(v) for i, v in rows if v and any(v)}
    want = {}
    for i in [i for i in valid if i % 50 == 0]:
        unit = lambda x: x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
        scores = sorted((-round(float(unit(valid[i]) @ unit(v)), 12), j) for j, v in valid.items() if j != i and len(v) == len(valid[i]))
        if scores:
            want[i] = [(j, -s) for s, j in scores[:5]]
    assert {len(made[i]) for i in want} == {3, 4, 5} and set(got) == set(want)
    for i, best in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in best]
        assert np.allclose([s for _, s in got[i]], [s for _, s in best])


def test_search_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    names = np.array(sorted(rows))
    u = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in names.tolist()])
    got: dict[int, set] = {}
    for r in multi_index.search(df, F.col("id") % 50 == 0, visit=multi_index.VISIT).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = asked = 0
    for q in names[names % 50 == 0].tolist():
        s = u @ (rows[q] / np.linalg.norm(rows[q]))
        s[names == q] = -2
        hits += len(got[q] & set(names[np.lexsort((names, -s))[:5]].tolist()))
        asked += 5
    assert hits / asked >= 0.9


# 9 mixing


def test_mixing(spark, corpus):
    rows = [(i, "w " * (i % 17), None, (None, "b", "a", "c")[i % 4]) for i in range(400)] + [(900, None, None, "z"), (901, "x y", None, "big")]
    docs = spark.createDataFrame([(i, t, la, s, 1, "h") for i, t, la, s in rows], DOCS)
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert sum(r.size for r in v) == v[0].source_size and v[0].target <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2 + 1e-9
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.taken // r.size for r in got if r.size) + sum(1 for r in mixing_zero(copies))
    assert mixing.mix(frame(spark, [])).count() == 0


def mixing_zero(copies):
    return copies.where("text IS NULL OR trim(text) = ''").collect()


# 10 Jaccard join


def brute_join(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, k, percent):
    rng = random.Random(k)
    texts = edge_texts()
    for _ in range(12):
        base = [rng.choice(VOCAB) + str(rng.randint(0, 40)) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(copy))
    shared = " ".join(VOCAB[i % 14] + str(i) for i in range(30))
    texts += [shared + " " + " ".join(rng.choice(VOCAB) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(15)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    got = ngram_join.join(frame(spark, rows), k=k, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute_join(rows, k, percent)


def test_sets_of_one_name(spark, monkeypatch):
    """Sets with equal first names are told apart by their second, and equal ones stay together."""
    names = ngram_join._names
    monkeypatch.setattr(ngram_join, "_name", lambda s, clashes: names(s)[1] if 5 in clashes else 5)
    monkeypatch.setattr(ngram_join, "_names", lambda s: (5, names(s)[1]))
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (4, "m n o p q r s")]
    got = ngram_join.join(frame(spark, rows), k=3, percent=90).collect()
    assert sorted(map(tuple, got)) == brute_join(rows, 3, 90)


def test_keep_one_matches_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, long), (5, long + " tail"), (5, "quite another text"), (9, "twice here"), (9, "twice here")])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, long), (5, "quite another text"), (9, "twice here")]


def test_jaccard_join_edges(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(5, long), (5, long), (3, long + " tail"), (None, long), (8, None)])
    got = ngram_join.join(docs)
    assert sorted(got.collect(), key=repr) == sorted([(5, 56, 3), (5, 56, 3), (3, 57, 3), (None, 56, 3), (8, 0, 8)], key=repr)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == ["3", "8", "None"]


def test_shingles_tell_texts_apart():
    a, b, c, d, e = shingle_sets([b"a b c d", b"A B\tC D", b"a b", b"ab", b""], 3)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == len(d) == 1 and c[0] != d[0] and len(e) == 0
