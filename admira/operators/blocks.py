"""Two sides of a join dealt to blocks, so that no group outgrows a task and no hot key stays whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast where it has at most ``most`` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` marked for a join by shuffle: Spark broadcasts by the bytes of files, and a small file may hold many rows."""
    return df.hint("merge")


def deal(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_block: int, right_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``lb`` and ``rb``: rows of equal ``key`` meet in exactly one cell (key, lb, rb).

    A key's rows are dealt by id to blocks of about the given sizes; a row goes along with every block of the other side.
    Keys of one side only are left out.
    """
    parts = lambda df, name, block: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    cells = bounded(parts(left, "__ls", left_block).join(parts(right, "__rs", right_block), key))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = left.join(cells, key).withColumn("lb", own(left_id, "__ls")).withColumn("rb", every("__rs")).drop("__ls", "__rs")
    right = right.join(cells, key).withColumn("rb", own(right_id, "__rs")).withColumn("lb", every("__ls")).drop("__ls", "__rs")
    return left, right


def every_pair(left: DataFrame, right: DataFrame, block: int = 4096) -> DataFrame:
    """Each row of ``left`` beside each of ``right``, block by block."""
    one = lambda df: df.withColumn("__key", F.lit(0)).withColumn("__id", F.xxhash64(*df.columns))
    a, b = deal(one(left), one(right), "__key", "__id", "__id", block, block)
    return a.drop("__id").join(b.drop("__id"), ["__key", "lb", "rb"]).drop("__key", "lb", "rb")
