"""Sentence-safe chunks with metadata, and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import degree_levels, split_sentences

MAX_CHARS, OVERLAP_CHARS = 1200, 150


def spans_of(sizes: np.ndarray, most: int, overlap: int) -> tuple[list[int], list[int]]:
    """The first and the last-but-one unit of each chunk, by binary search in prefix sums: no unit is looked at twice.

    A chunk ends before the unit that would pass ``most``; the next one begins with the last units that fit ``overlap``
    together, takes that unit in any case, and goes on.
    """
    ahead = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    starts, ends, start, end, n = [], [], 0, 1, len(sizes)
    while n:
        end = max(end, int(np.searchsorted(ahead, ahead[start] + most, side="right")) - 1)
        starts.append(start)
        ends.append(min(end, n))
        if end >= n:
            break
        start = max(start, int(np.searchsorted(ahead, ahead[end] - overlap, side="left")))
        end += 1
    return starts, ends


def pack_units(units: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Whole units packed greedily into chunks of up to ``most`` characters, a space counted with each.

    A unit is never split. The last units of a full chunk that fit ``overlap`` together begin the next one. Only the units'
    sizes go to Python; their texts are joined where they are.
    """

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def spans(sizes: pd.Series) -> pd.Series:
        made = (spans_of(np.asarray(x, dtype=np.int64), most, overlap) if x is not None else ([], []) for x in sizes)
        return pd.Series([[{"a": a, "b": b} for a, b in zip(*m, strict=True)] for m in made])

    found = spans(F.transform(units, lambda u: F.length(u) + 1))
    return F.when(units.isNotNull(), F.transform(found, lambda s: F.array_join(F.slice(units, s["a"] + 1, s["b"] - s["a"]), " ")))


def chunk_text(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    return pack_units(split_sentences(text), most, overlap)


def item_units(items: Column, most: int = MAX_CHARS) -> Column:
    """Trimmed items; those above ``most`` characters as their sentences."""
    given = F.filter(F.transform(items, lambda x: F.trim(x)), lambda i: i != "")
    return F.flatten(F.transform(given, lambda i: F.when(F.length(i) > most, split_sentences(i)).otherwise(F.array(i))))


def chunk_items(items: Column, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    return pack_units(item_units(items, most), most, overlap)


def chunk_metadata(category: Column, text: Column) -> Column:
    """What a chunk carries beside its text; the record's columns are university, location, province, source_pages, is_public."""
    return F.struct(
        F.translate(F.lower("university"), " -/", "___").alias("university_id"),
        F.col("university").alias("university_name"),
        F.coalesce("location", F.lit("")).alias("city"),
        F.coalesce("province", F.lit("")).alias("province"),
        category.alias("department"),
        category.alias("category"),
        degree_levels(text).alias("degree_levels"),
        F.array_join("source_pages", " | ").alias("source_pages"),
        F.length(text).alias("length_chars"),
        F.col("is_public").alias("is_public"),
    )


def build_chunks(records: DataFrame) -> DataFrame:
    """(chunk_id, category, text, metadata) of normalized records with their file ``stem``: six categories each."""
    fees = F.transform(F.filter("fee_structure.fees", lambda f: (F.coalesce(f["label"], F.lit("")) != "") & (F.coalesce(f["value"], F.lit("")) != "")), lambda f: F.concat(f["label"], F.lit(": "), f["value"]))
    lists = {"eligibility": "eligibility_criteria", "test_pattern": "test_pattern", "scholarships": "scholarships", "offered_courses": "offered_courses", "fee_structure": fees, "hostel": "hostel_info"}
    made = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.col(v) if isinstance(v, str) else v, F.array().cast("array<string>")).alias("items")) for c, v in lists.items()])
    rows = records.select("*", F.inline(made)).select("*", F.posexplode(chunk_items(F.col("items"))).alias("i", "chunk"))
    head = F.concat(F.lit("[University: "), F.col("university"), F.lit(" | Category: "), F.col("category"), F.lit("] "))
    return rows.select(F.concat_ws("_", "stem", "category", F.col("i").cast("string")).alias("chunk_id"), "category", F.concat(head, "chunk").alias("text"), chunk_metadata(F.col("category"), F.col("chunk")).alias("metadata"))


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder: signed counts of hashed words, scaled to length 1."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(chunks: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder, batch: int = 64, text: str = "text") -> DataFrame:
    """Add ``embedding``. The embedder is made once in a task; a batch that fails leaves its rows without a vector."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for series in parts:
            texts, out = [t or "" for t in series], []
            for a in range(0, len(texts), batch):
                part = texts[a : a + batch]
                try:
                    out += [v.tolist() for v in embedder(part)]
                except RuntimeError:
                    out += [None] * len(part)
            yield pd.Series(out)

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def build_vector_table(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that have a vector, rebuilt as a whole: ids without a chunk do not survive."""
    return chunks.join(vectors.where("embedding IS NOT NULL").select(key, "embedding"), key)
