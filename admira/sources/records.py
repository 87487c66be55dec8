"""Record files and tables: JSON scans, decoded PDF records, flat rows, upserts, schema growth and rebuilds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.blocks import spread


_BAD = "__bad"


def _schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _parsed(spark: SparkSession, path: str, schema: StructType, suffix: str, lines: bool) -> DataFrame:
    """(stem, value, rec): a row for each file, or for each line of the files; ``rec`` is null or marked where it is spoiled."""
    stem = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), f"{suffix}$" if suffix else "^$", "")
    marked = StructType([*schema.fields, StructField(_BAD, StringType())])
    rec = F.from_json("value", marked, {"columnNameOfCorruptRecord": _BAD})
    return spark.read.text(path, wholetext=not lines).select(stem.alias("stem"), "value", rec.alias("rec"))


def scan_json_records(spark: SparkSession, path: str, schema: StructType | str, suffix: str = "", lines: bool = False) -> DataFrame:
    """One JSON document a file (or a line), with ``stem``: the file's name without ending and suffix. Spoiled ones have nulls."""
    schema = _schema(schema)
    return _parsed(spark, path, schema, suffix, lines).select(*[F.col("rec")[f.name].alias(f.name) for f in schema], "stem")


def scan_with_rejects(spark: SparkSession, path: str, schema: StructType | str, suffix: str = "", lines: bool = False, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """The sound records, as ``scan_json_records`` gives them, and (stem, value) of the rest.

    Rejected are blank texts, texts that are no JSON document, and documents with a value of another type than the schema's.
    Files of no bytes are skipped by Spark and give no row.
    ``counts`` observes ``records`` and ``rejected`` when the sound records are read.
    """
    schema = _schema(schema)
    every = _parsed(spark, path, schema, suffix, lines).withColumn("spoiled", F.isnull("rec") | F.isnotnull(F.col("rec")[_BAD]))
    seen = every.observe(counts, F.count(F.lit(1)).alias("records"), F.count_if("spoiled").alias("rejected")) if counts else every
    good = seen.where(~F.col("spoiled")).select(*[F.col("rec")[f.name].alias(f.name) for f in schema], "stem")
    return good, every.where("spoiled").select("stem", "value")


def write_records(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite the whole output."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).format(kind).save(path)


PDF_SCHEMA = "source_url string, saved_path string, sha256 string, parsed struct<text string, tables array<struct<page int, header array<string>, rows array<array<string>>>>, metadata struct<parser string, pages_extracted int>>"


def _by_table(records: DataFrame) -> DataFrame:
    return records.select("source_url", "sha256", F.col("parsed.text").alias("text"), F.posexplode_outer("parsed.tables").alias("table_idx", "t")).select("source_url", "sha256", "text", "table_idx", "t.page", "t.header", "t.rows")


def scan_pdf_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Decoded PDF records, a row for each table; records without tables keep one row."""
    return _by_table(scan_json_records(spark, path, PDF_SCHEMA, lines=lines))


def scan_pdfs_with_rejects(spark: SparkSession, path: str, lines: bool = False, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``scan_pdf_records`` from the sound records, and (stem, value) of the rest."""
    good, rejected = scan_with_rejects(spark, path, PDF_SCHEMA, lines=lines, counts=counts)
    return _by_table(good), rejected


def guess_table_headers(rows: Column) -> Column:
    """The first row, if enough of its cells are filled and no plain numbers; else null."""
    first = F.get(rows, F.lit(0))
    worded = F.filter(first, lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.regexp_replace(F.trim(c), "[%.]", "").rlike(r"^\d+$"))
    return F.when(F.size(worded) >= F.greatest(F.lit(1), F.floor(F.size(first) / 2)), first)


def select_pdf_urls(pages: DataFrame, url: str = "url", needle: str = ".pdf") -> DataFrame:
    return pages.where(F.lower(url).contains(needle))


def content_address(files: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """(name, sha256, file_name): each content once under each name; the file is called ``stem-first 8 digits.ending``."""
    name = F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), "/"), -1)
    name = F.when(name == "", "download").otherwise(name)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    sha = F.sha2(F.col(content).cast("binary"), 256)
    ending = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return files.select(name.alias("name"), sha.alias("sha256"), F.concat(stem, F.lit("-"), F.substring(sha, 1, 8), ending).alias("file_name")).distinct()


def flatten_entity_record(records: DataFrame) -> DataFrame:
    """The flat row of a normalized record: lists joined and cut, a flag for scholarships, fees as text."""
    joined = lambda c, most: F.substring(F.concat_ws(" ", c), 1, most)
    fees = F.transform("fee_structure.fees", lambda f: F.concat(f["label"], F.lit(": "), f["value"]))
    return records.select(
        F.col("stem").alias("university_id"),
        F.col("university").alias("university_name"),
        F.col("location").alias("city"),
        "province",
        joined("eligibility_criteria", 2000).alias("eligibility_text"),
        joined("test_pattern", 2000).alias("test_pattern_text"),
        joined("scholarships", 2000).alias("scholarship_text"),
        F.coalesce(F.size("scholarships") > 0, F.lit(False)).alias("has_scholarships"),
        joined("hostel_info", 2000).alias("hostel_text"),
        F.substring(F.array_join(fees, " "), 1, 4000).alias("fee_text"),
        "offered_courses",
        "source_pages",
    )


def upsert_entities(target: DataFrame, batches: list[DataFrame], key: str) -> DataFrame:
    """The rows of the last batch for each key; other keys stay."""
    every = target.withColumn("__batch", F.lit(0))
    for i, b in enumerate(batches, 1):
        every = every.unionByName(b.withColumn("__batch", F.lit(i)))
    fields = target.columns
    return every.groupBy(key).agg(F.max_by(F.struct(*fields), "__batch").alias("r")).select("r.*")


def evolve_schema(target: DataFrame, schema: StructType) -> DataFrame:
    """Missing columns are added as nulls in the declared order; none is dropped."""
    added = target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in target.columns])
    return added.select(*[f.name for f in schema], *[c for c in target.columns if c not in schema.names])


def read_entities_with_fallback(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """The structured table where it exists and has rows; else what the records give, in the same columns."""
    if primary is None or primary.isEmpty():
        return fallback
    return primary.select(*fallback.columns)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fingerprint(spark: SparkSession, paths: Sequence[str], content: bool = False) -> str:
    """What tells states of input folders apart: number, lengths and times of their files, with ``content`` their bytes instead of the times.

    The files are listed and summed up by Spark; a missing folder is an empty one.
    """
    out = []
    for path in paths:
        fs, where = _fs(spark, path)
        if not fs.exists(where):
            out.append("-")
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        mark = F.sha2("content", 256) if content else F.unix_micros("modificationTime").cast("string")
        h = F.xxhash64("path", "length", mark)
        r = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        out.append(":".join(str(x) for x in r))
    return " ".join(out)


def _manifest(spark: SparkSession, path: str) -> str | None:
    """The manifest of a stage: the fingerprint of the inputs that it was built from; null where none was written."""
    fs, where = _fs(spark, f"{path}.manifest/_SUCCESS")
    return "\n".join(r.value for r in spark.read.text(f"{path}.manifest").collect()) if fs.exists(where) else None  # one row


def ensure_built(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, inputs: Sequence[str] = (), content: bool = False) -> bool:
    """Build a stage's output unless it is there, whole and of the present inputs; tells whether it was built.

    A manifest beside the output names the state of the folders in ``inputs`` (see ``fingerprint``). It goes before a build
    begins and is written after the output, so an interrupted build has none and runs again. An empty output is a built one.
    """
    now = fingerprint(spark, inputs, content)
    if not force and _manifest(spark, path) == now:
        return False
    fs, where = _fs(spark, f"{path}.manifest")
    fs.delete(where, True)
    write_records(build(), path)
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.text(f"{path}.manifest")
    return True


def recommendations_markdown(ranked: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, markdown): a report for each applicant with recommendations."""
    mark = lambda f: F.when(f["status"] == "pass", "✓").otherwise("⚠")
    bullets = F.array_join(F.transform("factors", lambda f: F.concat(F.lit("- "), mark(f), F.lit(" **"), f["label"], F.lit("**: "), f["detail"])), "\n")
    part = F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.lit(" — "), F.col("total_score").cast("string"), F.lit("% match\n\n"), bullets)
    body = ranked.groupBy("profile_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))), lambda r: r["part"]), "\n\n").alias("body"))
    about = F.array_join(F.array_compact(F.array(F.col("name"), F.nullif("field_of_study", F.lit("")), F.nullif("degree_level", F.lit("")))), " · ")
    return profiles.select("profile_id", about.alias("about")).join(spread(body), "profile_id").select("profile_id", F.concat(F.lit("# Recommendations\n\n"), "about", F.lit("\n\n"), "body", F.lit("\n")).alias("markdown"))
