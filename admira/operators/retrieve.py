"""Filtered nearest-neighbour retrieval, chunks of candidates, query texts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .nearest import nearest

def knn(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """questions(question_id, q) with their k nearest vectors(id, v, ...): a stated query set against all rows."""
    one = F.lit("")
    return nearest(questions.select("question_id", "q", one.alias("list")), vectors.withColumn("list", one), k)


def metadata_where(entity: str | None = None, categories: list[str] | None = None) -> Column:
    """Equality and membership on the parts that are given."""
    out = F.lit(True)
    if entity:
        out = out & (F.col("entity") == entity)
    if categories:
        out = out & F.col("category").isin(*categories)
    return out


def retrieve(questions: DataFrame, vectors: DataFrame, k: int = 6) -> DataFrame:
    """Filtered retrieval with fallbacks.

    questions(question_id, q, want_entity, want_categories, strict); vectors(id, v, entity, category). A question takes
    the hits of entity and categories; without any, those of its entity alone (if it named both); without any, and unless
    strict, all.

    Vectors stand in inverted lists by entity and category, by each of them, and in one of all. The sizes of the lists tell
    which tier a question needs, and it opens the lists of this tier only; lists that nobody opens are not built.
    """
    name = lambda *parts: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p), F.lit("*")) for p in parts])
    any_ = F.lit(None).cast("string")
    entity, category = F.col("entity"), F.col("category")
    lists = F.array_compact(F.array(F.when(entity.isNotNull() & category.isNotNull(), name(entity, category)), F.when(entity.isNotNull(), name(entity, any_)), F.when(category.isNotNull(), name(any_, category)), name(any_, any_)))
    sizes = vectors.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n")).select(F.explode(lists).alias("list")).distinct()

    asked, cats = F.col("want_entity"), F.array_distinct(F.array_compact(F.coalesce("want_categories", F.array().cast("array<string>"))))
    named, grouped = asked.isNotNull(), F.coalesce(F.size("want_categories"), F.lit(0)) > 0
    first = F.when(grouped, F.transform(cats, lambda c: name(asked, c))).otherwise(F.array(name(asked, any_)))
    second = F.when(named & grouped, F.array(name(asked, any_))).otherwise(F.array().cast("array<string>"))
    third = F.when(~F.col("strict") & (named | grouped), F.array(name(any_, any_))).otherwise(F.array().cast("array<string>"))
    tiers = F.array(*[F.struct(F.lit(i).alias("tier"), c.alias("lists")) for i, c in ((1, first), (2, second), (3, third))])
    wanted = questions.select("question_id", F.inline(tiers)).select("question_id", "tier", F.explode("lists").alias("list"))
    there = wanted.join(sizes, "list").withColumn("least", F.min("tier").over(W.partitionBy("question_id"))).where("tier = least")
    opened = there.select("question_id", "tier", "list").join(questions.select("question_id", "q"), "question_id")
    kept = vectors.select("id", "v", "entity", "category", F.explode(lists).alias("list")).join(opened.select("list").distinct(), "list", "left_semi")
    found = nearest(opened.select("question_id", "q", "list"), kept, k)
    tier = opened.select("question_id", "tier").distinct()
    return found.join(tier, "question_id").select("question_id", "rank", "id", "entity", "category", "distance", "tier")


def degree_filter(levels: Column, wanted: Column) -> Column:
    """Keep a chunk that names no level, or the wanted one; without a wanted level keep all."""
    none = F.coalesce(levels, F.lit("")) == ""
    return none | wanted.isNull() | (wanted == "") | F.array_contains(F.split(levels, ","), wanted)


def topk_per_entity(candidates: DataFrame, vectors: DataFrame, n: int = 4) -> DataFrame:
    """candidates(profile_id, id, q, level) with the n nearest of their entity's chunks (chunk_id, entity, v, levels):
    of the 3n nearest those of the wanted level."""
    asked = candidates.select(F.struct("profile_id", "id", "level").alias("question_id"), "q", F.col("id").cast("string").alias("list"))
    lists = vectors.select(F.col("chunk_id").alias("id"), "v", "levels", F.col("entity").cast("string").alias("list"))
    near = nearest(asked, lists, 3 * n).where(degree_filter(F.col("levels"), F.col("question_id.level")))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("distance", "id"))
    kept = near.withColumn("rank", place).where(F.col("rank") <= n)
    return kept.select("question_id.profile_id", F.col("question_id.id").alias("of"), "rank", F.col("id").alias("chunk_id"), "distance").withColumnRenamed("of", "id")


def structured_snippet() -> Column:
    """What is known of an institution as one text, for want of chunks."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = F.array(
        F.coalesce("name", F.col("id").cast("string")),
        filled("city"),
        F.when(filled("province") != "", F.concat(F.lit("province "), "province")),
        F.when(F.coalesce("fee_amount", F.lit(0)) != 0, F.trim(F.concat_ws(" ", F.lit("tuition"), F.col("fee_amount").cast("string"), "fee_period"))),
        F.when(F.col("min_eligibility").isNotNull(), F.concat(F.lit("min eligibility "), F.col("min_eligibility").cast("string"), F.lit("%"))),
        F.when(F.col("has_scholarships"), "scholarships available"),
        F.when(F.col("hostel"), "hostel available"),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ". ")


def attach_chunks(candidates: DataFrame, entities: DataFrame, vectors: DataFrame, n: int = 4) -> DataFrame:
    """Each candidate's chunk ids by nearness, or the structured text where it has none."""
    best = topk_per_entity(candidates, vectors, n).groupBy("profile_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c")))), lambda r: r["c"]), ",").alias("chunk_ids"))
    told = entities.select("id", structured_snippet().alias("snippet"))
    out = candidates.select("profile_id", "id").join(best, ["profile_id", "id"], "left").join(told, "id")
    return out.select("profile_id", "id", F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"), F.when(F.col("chunk_ids").isNull(), F.col("snippet")).otherwise("").alias("fallback"))


def verified_line() -> Column:
    """``[name | id | VERIFIED] a; b; c`` of the known fields."""
    known = F.array(
        F.when(F.coalesce("city", F.lit("")) != "", F.concat(F.lit("city: "), "city")),
        F.when(F.coalesce("fee_amount", F.lit(0)) != 0, F.concat(F.lit("tuition: "), F.format_number("fee_amount", 0), F.lit(" PKR "), F.replace("fee_period", F.lit("_"), F.lit(" ")))),
        F.when(F.col("min_eligibility").isNotNull(), F.concat(F.lit("min eligibility: "), F.col("min_eligibility").cast("string"), F.lit("%"))),
        F.when(F.col("hostel").isNotNull(), F.concat(F.lit("hostel: "), F.when(F.col("hostel"), "yes").otherwise("no"))),
        F.when(F.col("has_scholarships"), "scholarships: yes"),
    )
    return F.concat(F.lit("["), F.col("name"), F.lit(" | "), F.col("id").cast("string"), F.lit(" | VERIFIED] "), F.array_join(F.array_compact(known), "; "))


def profile_query_text() -> Column:
    """A profile as a search text; a default where it says nothing."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    cities = F.coalesce(F.size("preferred_cities"), F.lit(0)) > 0
    parts = F.array(
        F.when(given("field_of_study"), F.concat("field_of_study", F.lit(" program"))),
        F.when(given("degree_level"), F.concat("degree_level", F.lit(" degree eligibility"))),
        F.when(F.coalesce("budget_pkr_per_semester", F.lit(0)) != 0, F.concat(F.lit("budget around "), F.col("budget_pkr_per_semester").cast("string"), F.lit(" PKR per semester"))),
        F.when(cities, F.concat(F.lit("located in "), F.array_join("preferred_cities", ", "))).when(given("preferred_province"), F.concat(F.lit("located in "), "preferred_province")),
        F.when(F.col("scholarship_required"), "scholarships and financial assistance available"),
        F.when(F.coalesce("academic_percentage", F.lit(0)) != 0, F.concat(F.lit("academic percentage "), F.col("academic_percentage").cast("string"))),
        F.when(F.col("hostel_required"), "hostel accommodation available"),
    )
    text = F.array_join(F.array_compact(parts), ". ")
    return F.when(text == "", "university admission eligibility and programs").otherwise(text)


def source_label(page: Column, name: Column) -> Column:
    """One line of a source list: a web link with a short label, a curated note, or a plain page."""
    leaf = F.element_at(F.split(F.regexp_replace(page, "/+$", ""), "/"), -1)
    leaf = F.replace(F.replace(F.replace(F.element_at(F.split(leaf, r"\?"), 1), F.lit("%20"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    leaf = F.when(F.length(leaf) > 48, F.concat(F.substring(leaf, 1, 45), F.lit("…"))).otherwise(leaf)
    own = lambda sep, what: F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(sep), what)).otherwise(what)
    note = F.trim(F.replace(F.replace(page, F.lit("manual://"), F.lit("")), F.lit("-"), F.lit(" ")))
    web = F.concat(F.lit("- ["), own(": ", leaf), F.lit("]("), page, F.lit(")"))
    return F.when(page.rlike("^https?://"), web).when(page.startswith("manual://"), F.concat(F.lit("- "), own(" — ", note), F.lit(" (curated note)"))).otherwise(F.concat(F.lit("- "), own(" — ", page)))


def source_citations(hits: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, sources): the distinct pages of the hits (question_id, rank, name, source_pages), in order.

    Hits are taken until ``most`` lines stand, so the last hit may exceed it. A hit without pages is named once.
    """
    pages = F.filter(F.transform(F.split(F.coalesce("source_pages", F.lit("")), r" \| "), lambda x: F.trim(x)), lambda p: p != "")
    name = F.trim(F.coalesce("name", F.lit("")))
    rows = hits.withColumn("name", name).withColumn("p", F.when(F.size(pages) > 0, pages).when(F.col("name") != "", F.array(F.concat(F.lit("\x01"), "name"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("question_id", "rank", "name", F.posexplode("p").alias("i", "page"))
    first = rows.withColumn("again", F.row_number().over(W.partitionBy("question_id", "page").orderBy("rank", "i"))).where("again = 1")
    line = F.when(F.col("page").startswith("\x01"), F.concat(F.lit("- "), F.col("name"), F.lit(" (university dataset)"))).otherwise(source_label(F.col("page"), F.col("name")))
    before = F.count(F.lit(1)).over(W.partitionBy("question_id").orderBy("rank").rangeBetween(W.unboundedPreceding, -1))
    kept = first.withColumn("line", line).withColumn("before", before).where(F.col("before") < most)
    return kept.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "i", "line"))), lambda r: r["line"]), "\n").alias("sources"))
