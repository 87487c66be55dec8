"""Helpers the operators share: stage tables in the shared folder, running totals, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows up to which a side of a join may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: White space of the word contracts: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A temporary one is set only where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stages/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, marked for broadcast when that is few; else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add ``__row`` (from 0) and, for each ``{new: column}``, the sum of ``column`` over the rows before, in ``order``.

    Rows are dealt to partitions by range; only one total per partition meets in one task.
    """
    parts = stage(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "running")
    ahead = W.partitionBy("__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = parts.withColumn("__row", F.count(F.lit(1)).over(ahead)).withColumns({k: F.coalesce(F.sum(v).over(ahead), F.lit(0)) for k, v in sums.items()})
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("__pid").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    base = totals.select("__pid", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    out = local.join(F.broadcast(base), "__pid")  # a row for each shuffle partition at most
    return out.select(*df.columns, (F.col("__row") + F.col("__base")).alias("__row"), *[(F.col(k) + F.col(f"__b_{k}")).alias(k) for k in sums])
