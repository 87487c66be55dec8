"""The queries of this package, one for each operator and one for the pipeline, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat_windows, filter_audit, gif_media, language_id, line_dedup, lm_scoring, mixing, multi_index, ngram_join, sharding, token_files, turn_repair
from .common import shared_dir, stage


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.read_texts(stage(gif_media.store_texts(table(spark, sf_dir, "documents")), "media"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-files/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read(spark, path)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_windows.digest(chat_windows.windows(turns.unionByName(probe)))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_trigram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), order=3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_digest(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_gif_media, op3_best_fit_packing, op4_token_files, op5_chat_windows, op6_lm_scoring, op6_trigram_scoring, op7_language_id, op8_multi_index, op9_mixing, op10_ngram_jaccard_join, op11_turn_repair, op12_filter_audit, op13_sharding)}

ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op6_lm_scoring": lm_scoring.ORACLE_SQL, "op6_trigram_scoring": lm_scoring.TRIGRAM_SQL, "op9_mixing": mixing.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
