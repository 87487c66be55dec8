"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept, as stored, and returns the columns of ``documents``; the last returns the
places of the packed pieces. Edge cases are those of the operators: null texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admira.llm import best_fit, language_id, line_dedup, mixing, ngram_join
from admira.llm.common import stage
from admira.llm.queries import tokenizer_path


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_language(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80, extra=2)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack(docs, tokenizer_path())


STAGES = [("language ID", _language), ("line dedup", _lines), ("n-gram Jaccard join", _near_copies), ("mixing sources", _mix), ("best-fit packing", _pack)]

#: The language model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
