"""Best-fit-decreasing packing of tokenized documents into sequences.

Documents are tokenized where they are read; only lengths and checksums move. Pieces of full length fill a sequence
alone and are never shuffled. The others are dealt by hash into groups of about ``GROUP`` pieces; each group is packed
in one task by best-fit decreasing, with a segment tree over the remaining capacities that finds the tightest open bin in
logarithmic time. Sequences that a group leaves with much room are packed into one another in a second round, so that
groups cost hardly a sequence.

Defined results: a null text is an empty one (its only token is the end id); texts longer than a sequence are cut, the
first piece taking the remainder; repeated rows are packed once each; ties go by (doc_id, piece); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stage
from .encode import encoder, text_slices

#: Pieces that are packed together: some MB in a task. More would fill hardly fewer sequences.
GROUP = 4096


class OpenBins:
    """Bins by remaining capacity, in a segment tree whose leaves are the capacities and whose nodes count open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_id: int, room: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a bin with the least room that is at least ``need``: (bin, room)."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.bins[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each of ``lengths``, which are given in decreasing order."""
    open_bins, bins, offsets, made = OpenBins(capacity), [], [], 0
    for n in lengths:
        found = open_bins.tightest(n)
        if found is None:
            found, made = (made, capacity), made + 1
        bins.append(found[0])
        offsets.append(capacity - found[1])
        if found[1] > n:
            open_bins.put(found[0], found[1] - n)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    schema = "id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        coder, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            at: list[int] = []
            for a, b in text_slices(texts, 1 << 21):
                for i, ids_of in enumerate(coder.encode(texts[a:b]), a):
                    data = ids_of.astype("<u4").tobytes() + end
                    n = len(data) // 4
                    head = (n - 1) % capacity + 1
                    stops = [0, *range(head, n + 1, capacity)]
                    rows += [(p, s, e - s, zlib.crc32(data[4 * s : 4 * e])) for p, (s, e) in enumerate(zip(stops, stops[1:], strict=False))]
                    at += [i] * (len(stops) - 1)
            out = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(out[:, 0].astype(np.int32)), *[pa.array(out[:, k]) for k in (1, 2, 3)]], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stage(pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces")
    part = cut.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    full = cut.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths.tolist(), capacity)
        fill = np.bincount(bins, lengths, minlength=1).astype(np.int64)[bins]
        seq = np.array(bins, dtype=np.int64) * groups + (table["group"][0].as_py() if len(table) else 0)
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets, pa.int64())).append_column("fill", pa.array(fill))

    # the row's number, which the stored pieces keep, spreads rows that are alike in all else
    dealt = part.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("group").applyInArrow(place, schema + ", fill long")
    if groups > 1:
        packed = _merged(stage(packed, "packed"), capacity, group)
    return packed.drop("fill").unionByName(full).withColumnRenamed("id", doc_id)


def _merged(packed: DataFrame, capacity: int, group: int) -> DataFrame:
    """Second round: sequences that their groups left with much room are pieces now and packed into one another."""
    loose = F.col("fill") <= capacity * 3 // 4
    bundles = stage(packed.where(loose).groupBy("sequence_id").agg(F.min("fill").alias("length")), "bundles")
    n = bundles.count()
    groups = max(1, -(-n // group))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("sequence_id", "ascending")])
        bins, offsets = best_fit(table["length"].to_pylist(), capacity)
        names = table["sequence_id"].to_numpy()
        first: dict[int, int] = {}
        for b, name in zip(bins, names.tolist(), strict=True):
            first.setdefault(b, name)  # a bin keeps the number of its first sequence
        return pa.table({"was": pa.array(names), "now": pa.array([first[b] for b in bins], pa.int64()), "shift": pa.array(offsets, pa.int64())})

    moved = bundles.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("group").applyInArrow(place, "was long, now long, shift long")
    moved = bounded(stage(moved, "moved"), n)
    out = packed.join(moved, F.col("sequence_id") == F.col("was"), "left")
    places = {"sequence_id": F.coalesce("now", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
    return out.withColumns(places).drop("was", "now", "shift")
