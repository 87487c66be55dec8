"""Pages to fields: page types, programmes and fees of tables and texts, and their union for each institution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.text import is_noise_fee_label, is_noise_page_text, keyword_snippets, normalize_program_list, normalize_string_list, numeric_range, split_snippets

_NONE = F.array


def classify_page(url: Column, title: Column, types: dict[str, list[str]] = rules.PAGE_TYPES) -> Column:
    """The types whose words stand in address or title, in their order; ``all`` where none does."""
    low = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    found = F.array_compact(F.array(*[F.when(F.exists(F.lit(words), lambda w: low.contains(w)), F.lit(t)) for t, words in types.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("all")))


def extract_category_fields(pages: DataFrame, words: dict = rules.FIELD_WORDS, content: str = "content", types: str = "types", **noise) -> DataFrame:
    """Snippets of each field; eligibility and test pattern only from pages of their type or of no type."""
    gated = {"eligibility_criteria": "eligibility", "test_pattern": "test_pattern"}
    none = F.array().cast("array<string>")
    out = {}
    for field, (list_, most) in words.items():
        snippets = keyword_snippets(F.col(content), list_, most, **noise)
        if field in gated:
            snippets = F.when(F.array_contains(types, "all") | F.array_contains(types, gated[field]), snippets).otherwise(none)
        out[field] = snippets
    return pages.withColumns(out)


def has_program_indicator(text: Column) -> Column:
    return text.rlike(rules.PROGRAM_INDICATOR)


def is_catalog_line(text: Column) -> Column:
    return text.rlike(rules.CATALOG_CODE) | text.rlike(rules.CATALOG_WORDS)


def has_cost_info(text: Column) -> Column:
    return text.rlike(rules.COST_WORDS)


def looks_like_program_name(text: Column) -> Column:
    low = F.lower(text)
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    marked = F.exists(F.lit(rules.NON_PROGRAM_MARKERS), lambda m: low.contains(m))
    bad = marked | low.isin(*rules.GENERIC_LABELS) | text.rlike(r"^[\d)(\-/]") | text.contains("?") | (count(",") > 2) | (count("(") != count(")"))
    return ~bad & F.trim(text).rlike(rules.PROGRAM_START)


def split_program_blocks(cell: Column) -> Column:
    """A cell's blocks, each of which a duration begins; the duration goes."""
    parts = F.filter(F.split(cell, rules.DURATION_AHEAD), lambda b: F.trim(b) != "")
    return F.transform(parts, lambda b: F.trim(F.regexp_replace(b, rules.DURATION_PREFIX, "")))


def _clean_candidate(text: Column) -> Column:
    text = F.trim(F.regexp_replace(F.trim(text), r"(?i)^(degree)\s+", ""))
    at = F.regexp_instr(text, F.lit(rules.GARBLE))
    return F.when(at > 11, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def _programs_of(candidates: Column) -> Column:
    cleaned = F.transform(candidates, _clean_candidate)
    return F.filter(cleaned, lambda c: (F.length(c) >= 5) & ~is_noise_page_text(c) & ~is_catalog_line(c) & ~has_cost_info(c) & looks_like_program_name(c) & (F.size(F.split(c, r"\s+")) <= 30))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_programs(content: Column, tables: Column, most: int | None = 20) -> Column:
    """Programme names of a page: of table cells, else of whole rows, else of snippets; distinct, in order, ``most`` at most
    (None: all)."""

    def of_row(cells: Column) -> Column:
        own = F.filter(F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda x: F.trim(x)), lambda c: c != "")
        whole = lambda own: _bound(F.array_join(own, " "), lambda j: F.when(has_program_indicator(j), F.array(j)).otherwise(F.array().cast("array<string>")))
        source = _bound(own, lambda own: _bound(F.filter(own, has_program_indicator), lambda named: F.when(F.size(named) > 0, named).otherwise(whole(own))))
        return F.flatten(F.transform(source, split_program_blocks))

    rows = F.flatten(F.transform(tables, lambda t: t["rows"]))
    first = F.array_distinct(_programs_of(F.flatten(F.transform(rows, of_row))))
    more = _programs_of(F.filter(split_snippets(content), has_program_indicator))
    cut = lambda names: names if most is None else F.slice(names, 1, most)
    return _bound(first, lambda first: F.when(F.size(first) >= 10, cut(first)).otherwise(cut(F.array_distinct(F.concat(first, more)))))


def is_real_header(headers: Column) -> Column:
    """At most three in ten cells look like amounts."""
    n = F.size(headers)
    return (n > 0) & (F.size(F.filter(headers, lambda h: F.trim(h).rlike(rules.AMOUNT_LIKE))) <= n * 0.3)


def extract_fees(content: Column, tables: Column) -> Column:
    """array<struct(label, value)>: rows of fee tables, else up to five snippets that name a fee and a currency."""
    pair = "array<struct<label:string,value:string>>"

    def of_table(t: Column) -> Column:
        heads = F.filter(F.transform(F.filter(t["headers"], lambda h: h.isNotNull()), lambda x: F.trim(x)), lambda h: h != "")
        return _bound(heads, lambda heads: _bound(is_real_header(heads), lambda real: of_rows(t["rows"], heads, real)))

    def of_rows(rows: Column, heads: Column, real: Column) -> Column:
        is_fee = F.exists(heads, lambda h: F.lower(h).contains("fee") | F.lower(h).contains("amount"))

        def of_row(row: Column) -> Column:
            return _bound(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda cells: _bound(F.filter(cells, lambda c: c != ""), lambda filled: of_cells(cells, filled)))

        def of_cells(cells: Column, filled: Column) -> Column:
            both = F.zip_with(F.slice(heads, 2, 1000), F.slice(cells, 2, 1000), lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v)))
            value = F.when(real & (F.size(heads) == F.size(cells)), F.array_join(F.array_compact(both), " | ")).otherwise(F.array_join(F.slice(filled, 2, 1000), " | "))
            return F.when(F.size(filled) >= 2, _bound(F.struct(F.get(filled, F.lit(0)).alias("label"), value.alias("value")), kept))

        def kept(f: Column) -> Column:
            ok = ~is_noise_fee_label(f["label"]) & ~F.lower(f["label"]).isin(*rules.FEE_LABEL_STOPWORDS) & (f["value"] != "") & ~F.lower(F.trim(f["value"])).isin(*rules.FEE_VALUE_STOPWORDS)
            return F.when(F.coalesce(ok, F.lit(False)), f)

        return F.when(F.coalesce(is_fee, F.lit(False)), F.array_compact(F.transform(rows, of_row))).otherwise(F.array().cast(pair))

    listed = F.flatten(F.transform(tables, of_table))
    told = F.slice(F.filter(split_snippets(content), lambda s: F.lower(s).contains("fee") & F.lower(s).rlike(rules.FEE_CURRENCY)), 1, 5)
    none = F.coalesce(content, F.lit("")) == ""
    snippets = F.when(none, F.array().cast(pair)).otherwise(F.transform(told, lambda s: F.struct(F.lit("fee_snippet").alias("label"), s.alias("value"))))
    return _bound(listed, lambda listed: F.when(F.size(listed) > 0, listed).otherwise(snippets))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages of (university, pos, url, page_title, content, tables): six fields and the first 2000 characters."""
    typed = pages.withColumn("types", classify_page(F.col("url"), F.col("page_title")))
    fields = extract_category_fields(typed)
    return fields.withColumn("offered_courses", extract_programs(F.col("content"), F.col("tables"))).withColumn("fees", extract_fees(F.col("content"), F.col("tables"))).withColumn("raw_text", F.substring("content", 1, 2000)).drop("tables", "types")


def aggregate_pages(parsed: DataFrame, key: str, order: str, lists: list[str], plain: list[str] | None = None) -> DataFrame:
    """Each institution's lists in page order, each item once; the lists of ``plain`` keep repeats.

    Without lists that keep repeats, an item's repeats are combined before the rows of an institution meet.
    """
    none = F.array().cast(parsed.schema[lists[0]].dataType)
    if plain:
        joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("a")))), lambda x: x["a"]))
        return parsed.groupBy(key).agg(*[F.array_distinct(joined(c)).alias(c) for c in lists], *[joined(c).alias(c) for c in plain])
    made = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c), none).alias("a")) for c in lists])
    rows = parsed.select(F.col(key), F.col(order).alias("o"), F.inline(made)).select(key, "o", "c", F.posexplode_outer("a").alias("i", "item"))
    first = rows.groupBy(key, "c", "item", F.isnull("i").alias("empty")).agg(F.min(F.struct("o", "i")).alias("at"))
    of = lambda c: F.array_sort(F.collect_list(F.when((F.col("c") == c) & ~F.col("empty"), F.struct("at", "item"))))
    return first.groupBy(key).agg(*[F.transform(of(c), lambda x: x["item"]).alias(c) for c in lists])


def aggregate_items(parsed: DataFrame, key: str, order: str, items: str, block: int = 256) -> DataFrame:
    """(key, place, item): what ``aggregate_pages`` makes of one list, a row for each distinct item of an institution.

    ``order`` is an integer. Places are counted in blocks of ``block`` numbers and the blocks' sizes summed up, so that no
    task holds all items of an institution.
    """
    rows = parsed.select(F.col(key), F.col(order).cast("long").alias("o"), F.posexplode(items).alias("i", "item"))
    first = rows.groupBy(key, "item").agg(F.min(F.struct("o", "i")).alias("at")).withColumn("b", F.expr(f"at.o div {block}"))
    before = F.sum("n").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    sizes = first.groupBy(F.col(key).alias("__k"), F.col("b").alias("__b")).agg(F.count(F.lit(1)).alias("n")).select("__k", "__b", F.coalesce(before, F.lit(0)).alias("before"))
    placed = first.withColumn("r", F.row_number().over(W.partitionBy(key, "b").orderBy("at", "item")))
    met = placed.join(sizes, F.col(key).eqNullSafe(F.col("__k")) & F.col("b").eqNullSafe(F.col("__b")))
    return met.select(key, (F.col("before") + F.col("r")).alias("place"), "item")


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def official_site(pages: DataFrame, key: str, url: str = "url", order: str = "pos") -> DataFrame:
    """(key, site): ``https://`` and the commonest host, the first seen of equals; null without a host."""
    hosts = pages.withColumn("h", host(F.col(url)))
    counts = hosts.where("h != ''").groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.min_by("h", F.struct(-F.col("n"), "first")).alias("h"))
    return hosts.select(key).distinct().join(best, key, "left").select(key, F.concat(F.lit("https://"), "h").alias("site"))


def union_pages(scraped: DataFrame, manual: DataFrame) -> DataFrame:
    return scraped.unionByName(manual, allowMissingColumns=True)


def normalize_fee_entries(fees: Column) -> Column:
    """Trimmed pairs with label and value of which not both are boilerplate."""
    from ..functions.text import collapse, is_noise_record_text

    clean = F.transform(fees, lambda f: F.struct(collapse(f["label"]).alias("label"), collapse(f["value"]).alias("value")))
    return F.filter(clean, lambda f: (f["label"] != "") & (f["value"] != "") & ~(is_noise_record_text(f["label"]) & is_noise_record_text(f["value"])))


def normalize_records(parsed: DataFrame, seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Normalized records of aggregated ones: cleaned lists, derived columns, seed columns by slug, the official site.

    ``parsed`` has university, the lists, fees and source_pages; ``seeds`` has entity_id and the seed columns.
    """
    from ..functions.text import entity_slug, filter_marked_items, max_percentage, named_tests, tri_state_evidence
    from .explore import enrich

    lists = {c: normalize_string_list(F.col(c)) for c in ("eligibility_criteria", "test_pattern", "scholarships")}
    out = parsed.withColumns({**lists, "offered_courses": normalize_program_list(F.col("offered_courses")), "hostel_info": filter_marked_items(normalize_string_list(F.col("hostel_info")))})
    fees = normalize_fee_entries(F.col("fees"))
    out = out.withColumn("entity_id", entity_slug(F.col("university"))).withColumn("fees", fees)
    out = out.withColumns({
        "min_eligibility_percentage": max_percentage(F.col("eligibility_criteria")),
        "entry_test_name": named_tests(F.concat("eligibility_criteria", "test_pattern")),
        "hostel_available": tri_state_evidence(F.col("hostel_info")),
        "fee_structure": F.struct("fees", F.array_compact(F.transform("fees", lambda f: numeric_range(f["value"]))).alias("numeric_summary")),
    }).drop("fees")
    return enrich(out, seeds, "entity_id", ["location"]).join(sites.withColumnRenamed("site", "official_website"), "university", "left")


def page_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, tables): the tables of each page that has some, as array<struct<headers, rows>>."""
    from ..sources.html import extract_html_tables

    found = extract_html_tables(pages, key, html).where("kind = 'table'")
    whole = found.groupBy(key, "idx").agg(F.first("headers").alias("headers"), F.sort_array(F.collect_list(F.struct("row_idx", "cells"))).alias("rs"))
    made = F.struct("idx", "headers", F.transform("rs", lambda r: r["cells"]).alias("rows"))
    listed = F.transform(F.sort_array(F.collect_list(made)), lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows")))
    return whole.groupBy(key).agg(listed.alias("tables"))


def records_of_pages(pages: DataFrame, seeds: DataFrame, university: Column | None = None) -> DataFrame:
    """Normalized records, one for each institution, of raw pages (page_id, url, html): the whole chain.

    An institution is a host unless ``university`` names it otherwise; its lists follow the pages' ids. ``seeds`` as in
    ``normalize_records``. Pages without html have empty contents; a page without a host belongs to the institution "".
    """
    from ..sources.folders import stage
    from ..sources.html import html_to_page_record

    named = (university if university is not None else host(F.col("url"))).alias("university")
    read = html_to_page_record(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), named))
    none = F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>>>")
    met = read.join(page_tables(read), "page_id", "left").withColumn("tables", F.coalesce("tables", none))
    parsed = parse_pages(met.select("university", F.col("page_id").alias("pos"), "url", F.col("title").alias("page_title"), "content", "tables"))
    parsed = stage(parsed.withColumn("source_pages", F.array("url")), "parsed")
    lists = [*rules.FIELD_WORDS, "offered_courses", "source_pages"]
    whole = aggregate_pages(parsed, "university", "pos", lists).join(aggregate_pages(parsed, "university", "pos", ["fees"]), "university")
    return normalize_records(whole.withColumn("location", F.lit(None).cast("string")), seeds, official_site(parsed, "university"))
