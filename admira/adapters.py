"""Views of the driver tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["ring", "bolt", "gear", "plate", "widget", "gizmo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def offered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The courses of institutions as rows: (id, course) of all order lines, and (course, text) of parts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("course"))
    return lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course"), F.concat_ws(" ", "p_type", "p_name").alias("text"))


def entities(spark: SparkSession, sf_dir: str, courses: bool = True) -> DataFrame:
    """Institutions from suppliers; their courses from all order lines, each pair of supplier and part once.

    Without ``courses`` no course list is gathered and the column is missing.
    """
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    if courses:
        lines, part = offered(spark, sf_dir)
        listed = lines.distinct().join(part.hint("shuffle_hash"), "course").groupBy(F.col("id").alias("l_suppkey")).agg(F.array_sort(F.collect_set("text")).alias("courses"))  # few bytes stored, many rows
        base = base.join(listed, k == F.col("l_suppkey"), "left")
    return base.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.coalesce("n_name", F.lit("")).alias("city"),
        F.coalesce("r_name", F.lit("")).alias("province"),
        F.when(k % 10 != 0, F.floor(F.abs("s_acctbal") * 20).cast("int")).alias("fee_amount"),
        F.element_at(F.lit(["per_semester", "per_credit_hour", "per_year"]), (k % 3 + 1).cast("int")).alias("fee_period"),
        F.when(k % 7 != 0, (k % 50 + 40).cast("double")).alias("min_eligibility"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("hostel"),
        F.when(k % 4 == 0, True).when(k % 4 < 3, False).alias("is_public"),
        (k % 2 == 0).alias("has_scholarships"),
        (F.lit(24.8).cast("double") + (k % 30) / F.lit(100.0).cast("double")).alias("latitude"),
        (F.lit(67.0).cast("double") + (k % 20) / F.lit(100.0).cast("double")).alias("longitude"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example"))).alias("website"),
        *([F.coalesce("courses", F.array().cast("array<string>")).alias("courses")] if courses else []),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants from customers."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return base.select(
        k.alias("profile_id"),
        F.col("c_name").alias("name"),
        F.when(k % 11 != 0, F.floor(F.abs("c_acctbal") * 30).cast("int")).alias("budget_pkr_per_semester"),
        F.when(k % 13 != 0, (k % 50 + 50).cast("double")).alias("academic_percentage"),
        F.when(k % 9 != 0, F.element_at(F.lit(FIELDS), (k % 6 + 1).cast("int"))).otherwise("").alias("field_of_study"),
        F.element_at(F.lit(["Bachelor", "Master", "PhD"]), (k % 3 + 1).cast("int")).alias("degree_level"),
        F.when(k % 3 == 0, "fees").when(k % 3 == 1, "distance").alias("priority_focus"),
        F.when(k % 4 == 0, F.col("r_name")).alias("preferred_province"),
        F.when(k % 5 == 0, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("preferred_cities"),
        (k % 6 == 0).alias("hostel_required"),
        (k % 2 == 0).alias("scholarship_required"),
        F.when(k % 4 != 1, F.concat_ws(" ", F.lit("work on"), F.element_at(F.lit(FIELDS), (k % 5 + 1).cast("int")), F.lit("design"))).alias("career_goals"),
        F.when(k % 8 != 0, F.element_at(F.lit(["grade 9", "matric done", "Intermediate completed", "completed BS degree"]), (k % 4 + 1).cast("int"))).alias("current_education_level"),
        F.when(k % 3 != 2, F.lit(24.9).cast("double") + (k % 10) / F.lit(100.0).cast("double")).alias("latitude"),
        F.when(k % 3 != 2, F.lit(67.0).cast("double") + (k % 10) / F.lit(100.0).cast("double")).alias("longitude"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, student, entity, kind: an append-only log of actions."""
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "save", "signup", "save", "error", "unsave", "click", "unsave", "view", "save")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("student"), F.get_json_object("props", "$.k").cast("long").alias("entity"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("save")).alias("kind"), F.col("event_type"), "value",
    )


_CITY = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
ENTITIES = f"""
courses AS (SELECT l_suppkey, list_sort(list_distinct(list(p_type || ' ' || p_name))) AS courses FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
entities AS (SELECT s_suppkey AS id, s_name AS name, coalesce(n_name, '') AS city, coalesce(r_name, '') AS province,
  CASE WHEN s_suppkey % 10 <> 0 THEN CAST(floor(abs(s_acctbal) * 20) AS INTEGER) END AS fee_amount,
  ['per_semester', 'per_credit_hour', 'per_year'][s_suppkey % 3 + 1] AS fee_period,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 50 + 40 AS DOUBLE) END AS min_eligibility,
  CASE WHEN s_suppkey % 3 = 0 THEN true WHEN s_suppkey % 3 = 1 THEN false END AS hostel,
  CASE WHEN s_suppkey % 4 = 0 THEN true WHEN s_suppkey % 4 < 3 THEN false END AS is_public,
  s_suppkey % 2 = 0 AS has_scholarships,
  24.8::DOUBLE + (s_suppkey % 30) / 100.0::DOUBLE AS latitude, 67.0::DOUBLE + (s_suppkey % 20) / 100.0::DOUBLE AS longitude,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'https://s' || s_suppkey || '.example' END AS website,
  coalesce(courses, []::VARCHAR[]) AS courses
  FROM supplier LEFT JOIN ({_CITY}) ON s_nationkey = n_nationkey LEFT JOIN courses ON s_suppkey = l_suppkey)"""
_F = "['ring', 'bolt', 'gear', 'plate', 'widget', 'gizmo']"
PROFILES = f"""
profiles AS (SELECT c_custkey AS profile_id, c_name AS name,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(abs(c_acctbal) * 30) AS INTEGER) END AS budget_pkr_per_semester,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 50 + 50 AS DOUBLE) END AS academic_percentage,
  CASE WHEN c_custkey % 9 <> 0 THEN {_F}[c_custkey % 6 + 1] ELSE '' END AS field_of_study,
  ['Bachelor', 'Master', 'PhD'][c_custkey % 3 + 1] AS degree_level,
  CASE WHEN c_custkey % 3 = 0 THEN 'fees' WHEN c_custkey % 3 = 1 THEN 'distance' END AS priority_focus,
  CASE WHEN c_custkey % 4 = 0 THEN r_name END AS preferred_province,
  CASE WHEN c_custkey % 5 = 0 THEN [n_name] ELSE []::VARCHAR[] END AS preferred_cities,
  c_custkey % 6 = 0 AS hostel_required, c_custkey % 2 = 0 AS scholarship_required,
  CASE WHEN c_custkey % 4 <> 1 THEN 'work on ' || {_F}[c_custkey % 5 + 1] || ' design' END AS career_goals,
  CASE WHEN c_custkey % 8 <> 0 THEN ['grade 9', 'matric done', 'Intermediate completed', 'completed BS degree'][c_custkey % 4 + 1] END AS current_education_level,
  CASE WHEN c_custkey % 3 <> 2 THEN 24.9::DOUBLE + (c_custkey % 10) / 100.0::DOUBLE END AS latitude,
  CASE WHEN c_custkey % 3 <> 2 THEN 67.0::DOUBLE + (c_custkey % 10) / 100.0::DOUBLE END AS longitude
  FROM customer LEFT JOIN ({_CITY}) ON c_nationkey = n_nationkey)"""
EVENT_LOG = """
event_log AS (SELECT event_id AS seq, ts, user_id AS student, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity,
  CASE event_type WHEN 'error' THEN 'unsave' WHEN 'click' THEN 'unsave' ELSE 'save' END AS kind, event_type, value FROM events)"""
