"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every record has a stable key, the text of its id. A record and a shard give a hash, which is taken as a number ``u``
between 0 and 1; the shard with the largest ``-weight / ln(u)`` gets the record, so that a shard's share is in proportion
to its weight. The numbers of the other shards don't change when a shard is added, so a record either stays or moves to the
new shard; when one is taken away, only its own records move. No table of places is kept and nothing is shuffled to decide.

A record's slot is its rank within the shard by (key, text's checksum, size). Ranks come from ranges of the whole order and
one total for each range, so that a shard of any size is spread over tasks.

The law is ``key``: the id and the shards alone decide. So equal texts with different ids may part; what keeps them
together is another law.

Defined results: a null id is the key of its own, the empty text an id like others; rows of one key share a shard and have
slots of their own; a null text has no bytes (size 1, checksum 0); a shard of weight 0 gets no record; no shard of positive
weight is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

LAW = "key"


def record_key(doc_id: Column) -> Column:
    """A 64-bit hash of the id's text; the same for an id as int, long or string."""
    return F.when(doc_id.isNull(), F.xxhash64(F.lit("null"), F.lit(0))).otherwise(F.xxhash64(doc_id.cast("string")))


def unit(key: Column, shard: Column) -> Column:
    """The number strictly between 0 and 1 that a record and a shard give."""
    return (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(1 << 53)


def place(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a record with this key; ties go to the smaller number."""
    if not any(w > 0 for w in weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("shards need finite weights of 0 or more, one of them above 0")
    shards = [F.struct((F.lit(-float(w)) / F.ln(unit(key, F.lit(j)))).alias("score"), F.lit(-j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    return -(F.greatest(*shards) if len(shards) > 1 else shards[0])["shard"]


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (where ``grown`` weights put the record)."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    key = record_key(F.col("doc_id"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    later = F.lit(None).cast("int") if grown is None else place(key, grown)
    rows = rows.withColumns({"shard": place(key, weights), "grown_shard": later})
    order = [F.col("shard").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    ranked = running(rows, order, {})
    first = F.broadcast(ranked.groupBy(F.col("shard").alias("s")).agg(F.min("__row").alias("from")))  # a row for each shard
    out = ranked.join(first, F.col("shard") == F.col("s"))
    return out.select(F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("__row") - F.col("from")).alias("slot"), "grown_shard")
