"""Phrases in texts by one Aho-Corasick automaton: every phrase in one pass over a text, whatever their number.

Up to ``PHRASES`` phrases are sent to every task, which reads its texts where they are. More are dealt to blocks; a block's
automaton meets blocks of texts. Matching is exact, on characters as they are: lower both sides for a match without case.

Two rules: ``anywhere`` finds each phrase that a text contains; ``words`` reads a text from left to right as an alternation
of whole words would, the longest phrase first at a place, matches not overlapping.

Defined results: null and empty texts have no matches; null and empty phrases are left out; repeated phrases count once;
repeated ids each bring their rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal

#: Phrases that a task holds at a time.
PHRASES = 100_000
#: Texts of a block, where texts are dealt to blocks.
TEXTS = 1024


def automaton(phrases: Iterable[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in phrases:
        made.add_word(p, p)
    if len(made):
        made.make_automaton()
    return made


def _word(c: str) -> bool:
    """Whether a character is part of a word: letters, marks, digits and connectors of all alphabets."""
    return c.isalpha() or c == "_" or c.isdecimal() or (not c.isascii() and unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc", "Nl"))


def _border(text: str, at: int) -> bool:
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


def contained(made, text: str) -> list[tuple[int, str]]:
    """(0, phrase) of each phrase in the text, once."""
    return [(0, p) for p in sorted({p for _, p in made.iter(text)})]


def places(made, text: str) -> list[tuple[int, str]]:
    """(start, phrase) of the longest match of whole words at each place; these may overlap."""
    longest: dict[int, str] = {}
    for end, p in made.iter(text):
        start = end + 1 - len(p)
        if len(p) > len(longest.get(start, "")) and _border(text, start) and _border(text, end + 1):
            longest[start] = p
    return sorted(longest.items())


def read_on(found: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of sorted matches those that a reading from left to right takes: each begins where the one before has ended."""
    out, free = [], 0
    for start, p in found:
        if start >= free:
            out.append((start, p))
            free = start + len(p)
    return out


def whole_words(made, text: str) -> list[tuple[int, str]]:
    """(start, phrase) of the leftmost, then longest matches of whole words, from left to right."""
    return read_on(places(made, text))


_RULES = {"anywhere": contained, "words": whole_words}


def find(texts: DataFrame, phrases: DataFrame, rule: str = "anywhere", most: int = PHRASES) -> DataFrame:
    """texts(id, text) and phrases(phrase): id, start (from 0; 0 for ``anywhere``), phrase."""
    kind = texts.schema["id"].dataType.simpleString()
    wanted = phrases.select("phrase").where("phrase <> ''").distinct()
    given = texts.select("id", "text").where("text <> ''")
    out = f"id {kind}, start int, phrase string"

    def rows(ids: pa.Array, column: pa.Array, made, match=_RULES[rule]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(column), 256):
            at, found = [], []
            for i, text in enumerate(column.slice(a, 256).to_pylist()):
                hits = match(made, text) if len(made) else []
                at += [a + i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], names=["id", "start", "phrase"])

    few = [r.phrase for r in wanted.limit(most + 1).collect()]
    if len(few) <= most:
        sent = texts.sparkSession.sparkContext.broadcast(few)

        def scan(batches):
            made = automaton(sent.value)
            for batch in batches:
                yield from rows(batch.column(0), batch.column(1), made)

        return given.mapInArrow(scan, out)

    one = F.lit(0)
    left, right = deal(given.withColumn("key", one), wanted.withColumn("key", one), "key", "id", "phrase", TEXTS, most)
    cell = ("key", "lb", "rb")

    def meet(held: pa.Table, some: pa.Table) -> pa.Table:
        made = automaton(some.column("phrase").to_pylist())
        parts = [b for c in held.to_batches() for b in rows(c.column("id"), c.column("text"), made, places if rule == "words" else contained)]
        return pa.Table.from_batches(parts) if parts else pa.table({"id": held.column("id").slice(0, 0), "start": pa.array([], pa.int32()), "phrase": pa.array([], pa.string())})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, out)
    return _leftmost(found, texts) if rule == "words" else found


def _leftmost(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The matches of all blocks of phrases as one reading of each text."""
    kind = texts.schema["id"].dataType.simpleString()
    every = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", (-F.length("phrase")).alias("less"), "phrase"))).alias("m"))  # places of one text

    def run(batches):
        for batch in batches:
            at, kept = [], []
            for i, found in enumerate(batch.column(1).to_pylist()):
                taken = read_on((x["start"], x["phrase"]) for x in found)
                at += [i] * len(taken)
                kept += taken
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.string())], names=["id", "start", "phrase"])

    return every.mapInArrow(run, f"id {kind}, start int, phrase string")
