"""Tables in hash buckets that are rewritten bucket by bucket.

A commit writes the touched buckets anew under its number and then, last, a manifest: for each bucket the commit that holds
it. Readers take the newest manifest and exactly the folders it names, so they see one commit as a whole while later ones
are written, and a half-written commit is never seen. A commit that runs again under its number overwrites itself.

    path/data/commit=7/bucket=3/...     the rows of bucket 3 as of commit 7
    path/manifest/commit=7/...          (bucket, held): the buckets of the whole table after commit 7
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table; a manifest has a row for each.
BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket to the commit that holds it, by the newest commit (below ``before``); empty without one."""
    try:
        every = spark.read.schema("bucket int, held long, commit long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    known = every if before is None else every.where(F.col("commit") < before)
    newest = known.agg(F.max("commit")).first()[0]
    return {} if newest is None else {r.bucket: r.held for r in known.where(F.col("commit") == newest).collect()}  # a row for each bucket


def folders(path: str, held: dict[int, int]) -> list[str]:
    return [f"{path}/data/commit={c}/bucket={b}" for b, c in sorted(held.items())]


def read(spark: SparkSession, path: str, schema: str, held: dict[int, int] | None = None) -> DataFrame:
    """The table as of its newest commit; an empty one where there is none."""
    held = manifest(spark, path) if held is None else held
    return spark.read.schema(schema).parquet(*folders(path, held)) if held else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str, commit: int, buckets: int = BUCKETS, files: int = 1) -> list[int]:
    """Merge ``rows`` into the table: of each key the row with the largest ``order`` stays, a new one before a stored one
    of the same ``order``. Returns the rewritten buckets.

    Only the touched buckets are read and written, each in ``files`` files. ``commit`` numbers rise; an equal number
    replaces the commit.
    """
    spark, cols, schema = rows.sparkSession, rows.columns, rows.schema.simpleString()[len("struct<") : -1]
    fresh = rows.withColumns({"bucket": bucket_of(keys, buckets), "__new": F.lit(1)})
    before = manifest(spark, path, commit)
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # `buckets` numbers at most
    if touched or not before:
        old = read(spark, path, schema.replace(":", " "), {b: c for b, c in before.items() if b in touched})
        both = fresh.unionByName(old.withColumns({"bucket": bucket_of(keys, buckets), "__new": F.lit(0)}))
        last = F.max_by(F.struct(*cols), F.struct(order, "__new")).alias("r")
        merged = both.groupBy("bucket", *[F.col(k).alias(f"__k_{k}") for k in keys]).agg(last).select("bucket", "r.*")
        part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(1)), F.lit(files))
        merged.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/commit={commit}")
    now = before | dict.fromkeys(touched, commit)
    spark.createDataFrame(sorted(now.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/commit={commit}")
    return touched
