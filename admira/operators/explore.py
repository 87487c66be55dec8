"""The institutions' presentation view, search, saved marks, shortlists, option lists and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.text import fee_label, program_to_field, title_id


def entity_view(entities: DataFrame) -> DataFrame:
    """What a list shows of each institution: fee label, flags, the first six programmes and their number."""
    return entities.select(
        "id",
        F.coalesce("name", F.col("id").cast("string")).alias("name"),
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("province", F.lit("")).alias("province"),
        fee_label(F.col("fee_amount"), F.col("fee_period")).alias("fee_label"),
        "fee_amount",
        F.coalesce("fee_period", F.lit("")).alias("fee_period"),
        F.col("min_eligibility").alias("eligibility"),
        F.coalesce("has_scholarships", F.lit(False)).alias("has_scholarships"),
        "hostel",
        "is_public",
        F.coalesce("website", F.lit("")).alias("website"),
        F.slice("courses", 1, 6).alias("programs"),
        F.coalesce(F.size("courses"), F.lit(0)).alias("program_count"),
    )


def explore(view: DataFrame, query: str = "", chip: str = "all") -> DataFrame:
    """Substring search over name, city and programmes, and one chip; unknown flags match neither side."""
    chips = {"all": F.lit(True), "saved": "saved", "public": F.col("is_public"), "private": ~F.col("is_public"), "hostel": F.col("hostel"), "scholarships": F.col("has_scholarships")}
    blob = F.lower(F.concat_ws(" ", "name", "city", F.array_join("programs", " ")))
    picked = chips[chip] if isinstance(chips[chip], Column) else F.col(chips[chip])
    return view.where(blob.contains(query.strip().lower()) & F.coalesce(picked, F.lit(False)))


def mark_saved(pairs: DataFrame, shortlist: DataFrame) -> DataFrame:
    """``saved`` for each (profile_id, id) by the shortlist."""
    kept = shortlist.select("profile_id", "id", F.lit(True).alias("kept")).distinct()
    return pairs.join(kept, ["profile_id", "id"], "left").withColumn("saved", F.col("kept").isNotNull()).drop("kept")


def shortlist_details(shortlist: DataFrame, view: DataFrame) -> DataFrame:
    """Names of saved institutions; unknown ones get a name made from the id."""
    return shortlist.join(view.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", title_id(F.col("id"))))


def shortlist_by_recency(shortlist: DataFrame) -> DataFrame:
    return shortlist.withColumn("place", F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc("created_at"), F.desc("seq"), "id")))


def shortlist_counts(requests: DataFrame, before: DataFrame) -> DataFrame:
    """Per applicant how many ids a bulk request names (repeats counted) and how many of them are new."""
    given = requests.where(F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != ""))
    new = given.select("profile_id", "id").distinct().join(before.select("profile_id", "id"), ["profile_id", "id"], "left_anti")
    return given.groupBy("profile_id").agg(F.count(F.lit(1)).alias("requested")).join(new.groupBy("profile_id").agg(F.count(F.lit(1)).alias("added")), "profile_id", "left").select("profile_id", "requested", F.coalesce("added", F.lit(0)).alias("added"))


def added_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, after.columns, "left_anti").distinct()


def entity_options(entities: DataFrame, names: DataFrame, everything: str = "All Universities") -> DataFrame:
    """Choices of a form: all first, then each institution with its display name, else a name made from the id."""
    listed = entities.select(F.col("id").cast("string").alias("id")).join(names.select(F.col("id").cast("string").alias("id"), "label"), "id", "left")
    listed = listed.select(F.lit(1).alias("part"), "id", F.coalesce("label", title_id(F.col("id"))).alias("label"))
    return entities.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("all").alias("id"), F.lit(everything).alias("label")).unionByName(listed)


def lookup_entities(ids: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(ids.select("id").distinct(), "id", "left_semi")


def enrich(records: DataFrame, dimension: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Left lookup of seed columns by key; a value that the record has itself wins."""
    seed = dimension.select(F.col(key), *[F.col(c).alias(f"__seed_{c}") for c in dimension.columns if c != key])
    out = records.join(seed, key, "left")
    for c in dimension.columns:
        if c != key:
            out = out.withColumn(c, F.coalesce(c, f"__seed_{c}") if c in keep else F.col(f"__seed_{c}"))
    return out.drop(*[f"__seed_{c}" for c in dimension.columns])


def field_options(courses: DataFrame, include: str | None = None, course: str = "course") -> DataFrame:
    """(part, label): distinct labels whatever their case, the longest spelling of each; the current value first if new."""
    labels = courses.select(program_to_field(F.col(course)).alias("label")).where("label IS NOT NULL").groupBy(F.lower("label").alias("k")).agg(F.min_by("label", F.struct(-F.length("label"), "label")).alias("label"))
    out = labels.select(F.lit(1).alias("part"), "label")
    current = (include or "").strip()
    if current:
        first = courses.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(current).alias("label"))
        out = out.unionByName(first.join(labels.where(F.col("k") == current.lower()).select("k"), F.lower("label") == F.col("k"), "left_anti"))
    return out


def education_options(corpus: DataFrame, text: str = "text", specs=rules.EDUCATION_OPTIONS, default=rules.EDUCATION_DEFAULT) -> DataFrame:
    """(pos, label) of the options of which a pattern occurs in the corpus, in their order; the default where none does.

    One pass over the corpus gives a flag for each option; no text leaves its task.
    """
    flags = [F.coalesce(F.bool_or(F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(False)).alias(f"o{i}") for i, (_, patterns) in enumerate(specs)]
    seen = corpus.agg(*flags)
    named = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.col(f"o{i}").alias("on")) for i, (label, _) in enumerate(specs)])
    fallback = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.lit(True).alias("on")) for i, label in enumerate(default)])
    on = F.filter(named, lambda o: o["on"])
    return seen.select(F.inline(F.when(F.size(on) > 0, on).otherwise(fallback))).select("pos", "label")
