"""Applicant profiles: bounds, merging, completeness, stages and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.presence import is_present

_KIND = {"array": "array", "map": "map", "boolean": "boolean", "string": "string"}


def _kind(df: DataFrame, column: str) -> str:
    return _KIND.get(df.schema[column].dataType.typeName(), "number")


def present(df: DataFrame, column: str, mode: str = "empty") -> Column:
    return is_present(F.col(column), _kind(df, column), mode)


def sanitize_profile(df: DataFrame) -> DataFrame:
    """Values out of bounds are dropped: percentage 0-100, budget up to 50 million, test scores 0-2000."""
    pct, budget = F.col("academic_percentage").try_cast("double"), F.col("budget_pkr_per_semester").try_cast("double")
    out = df.withColumns({"academic_percentage": F.when(pct.between(0, 100), pct), "budget_pkr_per_semester": F.when((budget > 0) & (budget <= 50_000_000), F.floor(budget).cast("long"))})
    if "entry_test_scores" in df.columns:
        out = out.withColumn("entry_test_scores", F.map_filter("entry_test_scores", lambda _, v: v.between(0, 2000)))
    return out


def merge_profile_updates(updates: DataFrame, fields: list[str], key: str = "profile_id", order: str = "seq") -> DataFrame:
    """One profile for each key from all its updates: the last given value of each field."""
    last = [F.max_by(F.when(present(updates, f), F.col(f)), F.when(present(updates, f), F.col(order))).alias(f) for f in fields]
    return updates.groupBy(key).agg(*last)


def missing_required(df: DataFrame, fields: list[str] = rules.REQUIRED_FIELDS, mode: str = "empty") -> DataFrame:
    """``missing``: required fields that are not given, in order; ``ready`` when there are none."""
    gaps = [F.when(~present(df, f, mode), F.lit(f)) if f in df.columns else F.lit(f) for f in fields]
    return df.withColumn("missing", F.array_compact(F.array(*gaps))).withColumn("ready", F.size("missing") == 0)


def completeness(df: DataFrame, weights: dict[str, int] = rules.PROFILE_WEIGHTS) -> DataFrame:
    """``completeness_pct``: weight of the given fields in per cent of all, rounded half to even."""
    earned = F.lit(0)
    for field, weight in weights.items():
        if field in df.columns:
            earned = earned + F.when(present(df, field), weight).otherwise(0)
    return df.withColumn("completeness_pct", F.bround(earned * 100.0 / sum(weights.values()), 0).cast("int"))


def status_label(pct: Column) -> Column:
    return F.when(pct >= 85, "Complete").when(pct >= 50, "In Progress").otherwise("Getting Started")


def education_stage(text: Column) -> Column:
    """The highest stage that a text shows; a degree counts only with a word of completion near its first mention."""
    found = [F.when(text.rlike(p), F.lit(rank)) for rank, p in rules.STAGE_PATTERNS]
    for rank, p in rules.DEGREE_STAGES:
        start = F.regexp_instr(text, F.lit(p))
        length = F.length(F.regexp_substr(text, F.lit(p)))
        low = F.greatest(F.lit(1), start - 25)
        near = F.substring(text, low, start + length + 25 - low)
        found.append(F.when((start > 0) & near.rlike(rules.COMPLETION), F.lit(rank)))
    return F.array_max(F.array(*found))


def eligibility_block(degree: Column, education: Column) -> Column:
    """The stage is known and below what the degree needs."""
    needed = F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.STAGE_NEEDED.items() for x in pair]), degree)
    return F.coalesce((education != "") & (education_stage(education) < needed), F.lit(False))


def out_of_scope_region(cities: Column, province: Column, city: str, home: str) -> Column:
    """No preferred city holds the supported one; without cities, another province than its own."""
    own = F.lower(F.trim(F.coalesce(province, F.lit(""))))
    listed = F.coalesce(F.size(cities), F.lit(0)) > 0
    return F.when(listed, ~F.exists(cities, lambda c: F.lower(F.trim(c)).contains(city))).otherwise((own != "") & (own != home))
