"""Language ID with language-bitmask n-gram filters.

Training counts character n-grams per language in all labelled documents, added up within a task before they are
shuffled. A language keeps the ``TOP`` n-grams that are commonest in it and, per letter, not much rarer than in another
language. They go into one Bloom filter whose every position holds a word of bits, one bit a language (bit-sliced), so
that a look-up of an n-gram is the AND of ``HASHES`` words and gives all languages that have it at once.

A text is scored by its n-grams: per language the set bits are counted and corrected for the filter's false positives,
``(hits - n f) / (1 - f)`` with ``f`` from the filter's fill; the largest wins, ties going to the first name. The score
is the share of n-grams that the winner explains, 0 to 1.

Only letters count: a text is lower-cased, every run of other characters becomes one space, and n-grams of ``GRAM``
characters include the spaces at word borders.

Texts stay where they are read and go to Python by batches of rows, in slices of ``SLICE`` characters.

Defined results: null texts and texts without letters are ``und`` with score 0; rows without a label are never learned
from; a null doc_id is not held out; with no labelled row at all everything is ``und``; more than
``LANGUAGES`` labels are an error, none is left out; repeated rows get equal answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage
from .encode import text_slices
from .shingles import mix

#: n-grams that a language keeps.
TOP = 6000
GRAM = 3
#: Positions of the filter, and positions that an n-gram sets.
POSITIONS = 1 << 20
HASHES = 3
#: An n-gram stays in a language when its rate there is at least this share of its highest rate.
SHARE = 0.5
#: Languages in one word of the filter.
WORD_BITS = 62
#: Labels up to which the filter goes to every task: 8 MB for each ``WORD_BITS`` of them, so 132 MB here.
LANGUAGES = 1024
#: Characters that are looked at in one go, and counts that a task holds at a time.
SLICE, COUNTS = 1 << 18, 1 << 20
#: Steps from 0 to 1 in which scores are counted for the cuts.
STEPS = 1 << 14

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def grams(texts: list[str], size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit n-grams of all texts and the number of each text's: windows over its words, a space before and after each."""
    data = np.frombuffer(" ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    letter = _letter_table()[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word stands for the space behind it
    keep[0] = True
    code = np.where(letter, data, 32).astype(np.uint64)[keep]
    of = np.repeat(np.arange(len(texts)), sizes)[keep[1:]]
    out = code[: len(code) - size + 1].copy()
    for j in range(1, size):
        out = (out << np.uint64(21)) | code[j : len(code) - size + 1 + j]
    first = of[: len(out)]  # n-gram i ends with kept character i + size - 1, and 'of' starts at kept character 1
    last = of[size - 2 : size - 2 + len(out)]
    inside = (first == last) & ((out >> np.uint64(21)) & np.uint64((1 << 21) - 1) != 32)
    return out[inside], np.bincount(first[inside], minlength=len(texts))


def _places(g: np.ndarray) -> list[np.ndarray]:
    return [(mix(g + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))) & np.uint64(POSITIONS - 1)).astype(np.int64) for j in range(HASHES)]


def _labelled(docs: DataFrame, lang: str, text: str) -> DataFrame:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def tops(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Every language's n-grams, from all rows of ``labelled`` that have a label and a text."""
    rows = _labelled(labelled, lang, text)
    found = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: raise language_id.LANGUAGES if tasks can hold the filter")

    def added(held: dict):
        for name, parts in held.items():
            seen, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(at, np.concatenate([p[1] for p in parts]), len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for at in range(0, len(batch), 256):  # some hundred rows are Python objects at a time
                names, texts = (batch.column(i).slice(at, 256).to_pylist() for i in (0, 1))
                for a, b in text_slices(texts, SLICE):
                    g, n = grams(texts[a:b])
                    of = np.repeat(np.arange(b - a), n)
                    for name in sorted(set(names[a:b])):
                        mine = np.array([x == name for x in names[a:b]])
                        held.setdefault(name, []).append(np.unique(g[mine[of]], return_counts=True))
                        size += len(held[name][-1][0])
                    if size > COUNTS:
                        yield from added(held)
                        held, size = {}, 0
        yield from added(held)

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stage(counted, "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    rate = counted.where("n > 1").join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("all"))
    peak = rate.groupBy("gram").agg(F.max("rate").alias("peak"))
    typical = rate.join(peak, "gram").where(F.col("rate") >= SHARE * F.col("peak"))
    best = typical.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= TOP)
    got = best.select("lang", "gram").toArrow()  # TOP rows a language at most
    names, gram = np.array(got["lang"].to_pylist(), dtype=object), got["gram"].to_numpy().view(np.uint64)
    return {name: gram[names == name] for name in found}


def bit_filter(of: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The languages and the filter (POSITIONS x words)."""
    langs = list(of)
    table = np.zeros((POSITIONS, max(1, -(-len(langs) // WORD_BITS))), dtype=np.uint64)
    for i, name in enumerate(langs):
        for place in _places(of[name]):
            table[place, i // WORD_BITS] |= np.uint64(1 << i % WORD_BITS)
    return langs, table


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    return bit_filter(tops(labelled, lang, text))


def _judge(texts: list, langs: list[str], table: np.ndarray, false: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    g, n = grams(texts)
    places = _places(g)
    found = table[places[0]]
    for place in places[1:]:
        found &= table[place]
    ends = np.concatenate([[0], np.cumsum(n)])
    hits = np.zeros((len(langs), len(texts)))
    for i in range(len(langs)):
        running = np.concatenate([[0], np.cumsum((found[:, i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1)).astype(np.int32))])
        hits[i] = running[ends[1:]] - running[ends[:-1]]
    has = np.array([m > 0 or any(map(str.isalpha, t)) for m, t in zip(n.tolist(), texts, strict=True)], dtype=bool)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    true = np.maximum((hits - n * false[:, None]) / (1 - false[:, None]), 0)
    best, share = true.argmax(axis=0), np.clip(true.max(axis=0) / np.maximum(n, 1), 0, 1)
    return [langs[i] if ok else "und" for i, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, share, 0)


def _judged(model):
    """A function from a batch's texts to languages and scores; the filter, of fixed size, is broadcast."""

    def run(batches, column: int):
        langs, table = model.value
        fill = [np.count_nonzero(table[:, i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1)) / POSITIONS for i in range(len(langs))]
        false = np.array([f**HASHES for f in fill])
        for batch in batches:
            col, at = batch.column(column), 0
            names, scores = [], [np.empty(0)]
            while at < len(batch):  # some hundred rows are Python objects at a time
                texts = [t or "" for t in col.slice(at, 256).to_pylist()]
                for a, b in text_slices(texts, SLICE):
                    name, score = _judge(texts[a:b], langs, table, false)
                    names += name
                    scores.append(score)
                at += 256
            yield batch, names, np.concatenate(scores)
            pa.default_memory_pool().release_unused()

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    judged = _judged(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for batch, names, scores in judged(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    model = train(docs.where(~held_out(doc_id)), lang, text)
    return predict(docs, model, doc_id, text).select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")


def cuts(docs: DataFrame, model: tuple[list[str], np.ndarray], most: float, lang: str = "lang", text: str = "text") -> dict[str, float]:
    """The least score that a language's documents may have: half of what all but one in a hundred of its labelled ones
    reach, ``most`` at most. So a language of which the filter holds a small part only, or with few labels, keeps its texts.

    Scores of all labelled documents are counted in ``STEPS``.
    """
    scored = predict(_labelled(docs, lang, text), model, "lang", "text").where("lang = lang_pred")
    counted = stage(scored.groupBy("lang", F.floor(F.col("score") * STEPS).alias("s")).agg(F.count(F.lit(1)).alias("n")), "scores")
    total = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("s"))  # STEPS + 1 rows a language at most
    reached = counted.select("lang", "s", upto.alias("upto")).join(total, "lang").where(F.col("upto") * 100 >= F.col("all"))
    low = {r.lang: r.low / STEPS for r in reached.groupBy("lang").agg(F.min("s").alias("low")).collect()}  # a row for each learned language
    return {name: min(most, low.get(name, 0.0) / 2) for name in model[0]}


def keep_language(docs: DataFrame, most: float = 0.2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the documents that are in no learned language: no letters, or a score below the language's cut.

    The model learns from all labelled rows.
    """
    model = train(docs, lang, text)
    least = cuts(docs, model, most, lang, text)
    judged = _judged(docs.sparkSession.sparkContext.broadcast(model))
    column = docs.columns.index(text)

    def run(batches):
        for batch, names, scores in judged(batches, column):
            yield batch.filter(pa.array([name in least and score >= least[name] for name, score in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
