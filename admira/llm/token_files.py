"""Token files: all documents' ids in doc_id order, compressed by the adaptive range coder, and their reader.

Texts are dealt to files by ranges of doc_id and the text's hash and sorted, so file after file holds the corpus in order. A file is Parquet
with a row for each chunk of about ``CHUNK`` ids (the last one has from half to one and a half of it, if no very long document
comes before it, as a step of the coder costs much the same for few blocks): the doc_ids, their numbers of ids, and the coded blocks. The place of a
document in the whole stream is a sum over files, over the file's chunks and within the chunk; only the first sum meets in
one task, with a row for each file.

Defined results: a null text has only the end id; documents go by (doc_id, hash of the text), null doc_ids first; ids
above 65535 raise an error; repeated rows are
stored once each; an empty table gives files without rows and an empty result; other columns are ignored. A damaged block
raises an error when it is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import range_coder
from .common import bounded
from .encode import encoder, text_slices

#: Ids of a chunk, about: some MB in a task, and blocks enough to be coded side by side.
CHUNK = 1 << 22


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token files of ``docs`` under ``path``."""
    schema = "part int, chunk int, n_ids long, doc_ids array<bigint>, counts array<bigint>, data binary"

    def run(batches):
        coder, part, chunk = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, names, total = [], [], 0

        def row(held, names):
            ids = np.concatenate(held).astype(np.int64)
            counts = [len(x) for x in held]
            cols = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([range_coder.encode(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "n_ids", "doc_ids", "counts", "data"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_slices(texts, 1 << 21):
                for i, got in enumerate(coder.encode(texts[a:b]), a):
                    held.append(np.append(got, np.uint32(end_id)))
                    names.append(ids[i])
                    total += len(held[-1])
                    while total >= CHUNK + CHUNK // 2:
                        ends = np.cumsum([len(x) for x in held])
                        k = int(np.searchsorted(ends, CHUNK)) + 1
                        yield row(held[:k], names[:k])
                        held, names, total, chunk = held[k:], names[k:], total - int(ends[k - 1]), chunk + 1
        if held:
            yield row(held, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """A row for each stored document: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    chunks = files.select("part", "chunk", "n_ids")
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each file
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    places = chunks.select("part", "chunk", F.coalesce(inner, F.lit(0)).alias("inner")).join(F.broadcast(parts), "part").select("part", "chunk", (F.col("inner") + F.col("ahead")).alias("base"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = range_coder.decode(batch.column(4)[i].as_py()).astype("<u4")
                names = batch.column(2)[i].values
                counts = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                where = [pa.array(np.full(len(counts), batch.column(k)[i].as_py(), dtype=np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*where, names, pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["part", "chunk", "id", "local", "n_tokens", "ids_crc32"])

    docs = files.select("part", "chunk", "doc_ids", "counts", "data").mapInArrow(run, "part int, chunk int, id long, local long, n_tokens long, ids_crc32 long")
    out = docs.join(bounded(places, chunks.count()), ["part", "chunk"])
    return out.select(F.col("id").alias(doc_id), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
