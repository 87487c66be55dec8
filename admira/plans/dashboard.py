"""Queries of the dashboard, the catalogue and the shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ENTITIES, EVENT_LOG, PROFILES, entities, event_log, places, profiles, table
from ..functions.text import fee_label
from ..operators import analytics as A
from ..operators import explore as X
from ..operators.retrieve import structured_snippet, verified_line
from ..streaming.state import shortlist_state
from .registry import query

_LABEL = "CASE WHEN fee_amount <> 0 THEN trim(format('{:,}', fee_amount) || ' PKR ' || replace(fee_period, '_', ' ')) END"
_V = f"WITH {ENTITIES}, v AS (SELECT *, min_eligibility AS eligibility, courses[1:6] AS programs, len(courses) AS program_count, {_LABEL} AS fee_label FROM entities)"
_HAS = "(fee_amount IS NOT NULL AND fee_amount <> 0)"
_CREDIT = "fee_period LIKE '%credit%'"
_SHORT = f"""{EVENT_LOG}, drops AS (SELECT student, entity, max(CASE WHEN kind = 'unsave' THEN seq END) AS dropped FROM event_log GROUP BY 1, 2),
shortlist AS (SELECT l.student AS profile_id, l.entity AS id, arg_min(ts, seq) AS created_at, min(seq) AS seq FROM event_log l JOIN drops d ON l.student = d.student AND l.entity = d.entity
 WHERE kind = 'save' AND (dropped IS NULL OR seq > dropped) GROUP BY 1, 2)"""


def _view(spark, d):
    return X.entity_view(entities(spark, d))


def _short(spark, d):
    return shortlist_state(event_log(spark, d))


@query("s14_entity_view", f"{_V} SELECT id, name, city, province, fee_label, eligibility, has_scholarships, hostel, is_public, website, array_to_string(programs, '|') AS programs, program_count FROM v")
def view(spark, d):
    return _view(spark, d).select("id", "name", "city", "province", "fee_label", "eligibility", "has_scholarships", "hostel", "is_public", "website", F.array_join("programs", "|").alias("programs"), "program_count")


@query("p18_fee_label", f"{_V} SELECT id, fee_label FROM v")
def label(spark, d):
    return entities(spark, d).select("id", fee_label(F.col("fee_amount"), F.col("fee_period")).alias("fee_label"))


@query("f1_explore", f"{_V} SELECT id, name FROM v WHERE contains(lower(name || ' ' || city || ' ' || array_to_string(programs, ' ')), 'gear') AND is_public = false")
def explore(spark, d):
    return X.explore(_view(spark, d), "gear", "private").select("id", "name")


for _c, _w in (("public", "is_public"), ("hostel", "hostel"), ("scholarships", "has_scholarships"), ("all", "true")):
    query(f"f1_explore_{_c}", f"{_V} SELECT id FROM v WHERE {_w}")(lambda spark, d, c=_c: X.explore(_view(spark, d), "", c).select("id"))


@query("a3_tri_state_counts", f"{_V} SELECT count(*) FILTER (WHERE hostel) AS yes, count(*) FILTER (WHERE NOT hostel) AS no, count(*) FILTER (WHERE hostel IS NULL) AS unknown FROM v")
def tri(spark, d):
    return A.tri_state_counts(_view(spark, d), "hostel")


_BUCKET = f"CASE WHEN NOT {_HAS} THEN 5 WHEN {_CREDIT} THEN 4 WHEN fee_amount < 50000 THEN 0 WHEN fee_amount < 150000 THEN 1 WHEN fee_amount < 400000 THEN 2 ELSE 3 END"


@query("a4_fee_buckets", f"{_V} SELECT l.pos, l.label, count(v.id) AS n FROM (VALUES (0, 'Under 50k'), (1, '50k – 150k'), (2, '150k – 400k'), (3, '400k+'), (4, 'Per credit hour'), (5, 'No fee listed')) l(pos, label) LEFT JOIN v ON {_BUCKET} = l.pos GROUP BY 1, 2")
def buckets(spark, d):
    return A.fee_buckets(_view(spark, d))


@query("a5_period_mix", f"{_V} SELECT CASE WHEN NOT {_HAS} THEN 'No fee listed' WHEN fee_period = 'per_semester' THEN 'Per Semester' WHEN fee_period = 'per_year' THEN 'Per Year' ELSE 'Per Credit Hour' END AS label, count(*) AS n FROM v GROUP BY 1")
def mix(spark, d):
    return A.period_mix(_view(spark, d))


_SHARE = "CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {0}) / count(*), 1) AS DOUBLE)"


@query("a6_field_completeness", f"{_V} " + " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS label, {_SHARE.format(w)} AS percent FROM v" for i, (n, w) in enumerate([("Fee", _HAS), ("Eligibility %", "eligibility <> 0"), ("Hostel flag", "hostel IS NOT NULL"), ("Sector flag", "is_public IS NOT NULL"), ("Website", "website <> ''"), ("Programs", "program_count > 0")])))
def complete(spark, d):
    return A.field_completeness(_view(spark, d))


_THEMES = [("Rings", ["ring", "bolt"]), ("Gears", ["gear"]), ("Plates", ["plate", "steel"]), ("None", ["zzz"]), ("Widgets", ["widget", "gizmo"])]


@query("a7_theme_counts", f"{_V}, t AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS label, count(*) FILTER (WHERE {' OR '.join(f'contains(b, {chr(39)}{w}{chr(39)})' for w in ws)}) AS n FROM (SELECT lower(array_to_string(programs, ' ')) AS b FROM v)" for i, (n, ws) in enumerate(_THEMES)) + ") SELECT CAST(row_number() OVER (ORDER BY n DESC, pos) AS INTEGER) AS place, label, n FROM t QUALIFY place <= 4")
def themes(spark, d):
    return A.theme_counts(_view(spark, d), _THEMES, 4)


@query("a8_fee_vs_eligibility", f"{_V} SELECT id, eligibility AS x, CASE WHEN {_CREDIT} THEN fee_amount * 15.0::DOUBLE ELSE fee_amount::DOUBLE END AS y, name AS label, replace(fee_period, '_', ' ') AS period, {_CREDIT} AS estimated FROM v WHERE {_HAS} AND eligibility IS NOT NULL")
def scatter(spark, d):
    return A.fee_vs_eligibility(_view(spark, d))


@query("a9_entity_matrix", f"{_V} SELECT id, name, coalesce(fee_label, '—') AS fee_label, CASE WHEN {_HAS} THEN CASE WHEN {_CREDIT} THEN fee_amount * 15.0::DOUBLE ELSE fee_amount::DOUBLE END END AS semester_est, eligibility, hostel, is_public, has_scholarships AS scholarships, program_count AS programs FROM v")
def matrix(spark, d):
    return A.entity_matrix(_view(spark, d))


@query("a10_summary", f"""{_V} SELECT count(*) AS total, count(*) FILTER (WHERE is_public) AS public, count(*) FILTER (WHERE NOT is_public) AS private, count(*) FILTER (WHERE hostel) AS hostel_yes, count(*) FILTER (WHERE has_scholarships) AS scholarships,
CAST(round_even(sum(fee_amount::DOUBLE) FILTER (WHERE {_HAS}) / count(*) FILTER (WHERE {_HAS}), 0) AS DOUBLE) AS avg_fee, count(*) FILTER (WHERE {_HAS}) AS fee_coverage, CAST(round_even(sum(eligibility) / count(eligibility), 1) AS DOUBLE) AS avg_eligibility,
list_sort(list(program_count))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_programs FROM v""")
def summary(spark, d):
    return A.summary(_view(spark, d))


@query("a11_insights")
def insights(spark, d):
    return A.insights(_view(spark, d))


@query("a12_series_per_entity", f"""{_V} SELECT 'fees' AS series, id, name AS label, fee_amount::DOUBLE AS value, replace(fee_period, '_', ' ') AS period FROM v WHERE {_HAS}
UNION ALL SELECT 'eligibility', id, name, eligibility, NULL FROM v WHERE eligibility IS NOT NULL UNION ALL SELECT 'programs', id, name, program_count::DOUBLE, NULL FROM v""")
def series(spark, d):
    return A.series_per_entity(_view(spark, d))


@query("a13_missing_value_report", f"{_V} SELECT 'fee' AS field, string_agg(name, ', ' ORDER BY name) AS names FROM v WHERE NOT {_HAS} UNION ALL SELECT 'eligibility', string_agg(name, ', ' ORDER BY name) FROM v WHERE eligibility IS NULL")
def missing(spark, d):
    return A.missing_value_report(_view(spark, d))


@query("a14_field_options")
def field_options(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("Bachelor of "), "p_type", F.lit(" "), "p_name").alias("course"))
    return X.field_options(part, include="Medicine")


_SPECS = [("Open", [r"\blicen[sc]e\b"]), ("Never", [r"\bzzqx\b"]), ("Common", [r"\bthe\b", r"\bder\b"])]


@query("a15_education_options", r"SELECT 0 AS pos, 'Open' AS label WHERE (SELECT bool_or(regexp_matches(text, '\blicen[sc]e\b', 'i')) FROM documents) UNION ALL SELECT 2, 'Common' WHERE (SELECT bool_or(regexp_matches(text, '\b(the|der)\b', 'i')) FROM documents)")
def education(spark, d):
    return X.education_options(table(spark, d, "documents"), specs=_SPECS)


@query("a16_shortlist_counts", f"""WITH {_SHORT}, r AS (SELECT student AS profile_id, entity + 1 AS id FROM event_log WHERE entity IS NOT NULL)
SELECT r.profile_id, count(*) AS requested, count(DISTINCT r.id) FILTER (WHERE s.id IS NULL) AS added FROM r LEFT JOIN shortlist s ON r.profile_id = s.profile_id AND r.id = s.id GROUP BY 1""")
def counts(spark, d):
    asked = event_log(spark, d).select(F.col("student").alias("profile_id"), (F.col("entity") + 1).alias("id"))
    return X.shortlist_counts(asked, _short(spark, d))


@query("j1_enrich", f"SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'own' END, n_name) AS location, r_name AS province FROM supplier LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) ON s_nationkey = n_nationkey")
def enrich(spark, d):
    records = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("place"), F.when(F.col("s_suppkey") % 3 == 0, "own").alias("location"))
    seeds = places(spark, d).where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("location"), F.col("r_name").alias("province"))
    return X.enrich(records, seeds, "place", ["location"]).select("s_suppkey", "location", "province")


@query("j5_mark_saved", f"WITH {_SHORT} SELECT e.student AS profile_id, e.entity AS id, s.id IS NOT NULL AS saved FROM (SELECT DISTINCT student, entity FROM event_log) e LEFT JOIN shortlist s ON e.student = s.profile_id AND e.entity = s.id")
def mark_saved(spark, d):
    return X.mark_saved(event_log(spark, d).select(F.col("student").alias("profile_id"), F.col("entity").alias("id")).distinct(), _short(spark, d))


@query("j6_shortlist_details", f"WITH {_SHORT}, {ENTITIES} SELECT s.profile_id, s.id, coalesce(e.name, CAST(s.id AS VARCHAR)) AS name FROM shortlist s LEFT JOIN entities e ON s.id = e.id")
def details(spark, d):
    return X.shortlist_details(_short(spark, d), _view(spark, d)).select("profile_id", "id", "name")


@query("w7_shortlist_by_recency", f"WITH {_SHORT} SELECT profile_id, id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, seq DESC, id) AS INTEGER) AS place FROM shortlist")
def recency(spark, d):
    return X.shortlist_by_recency(_short(spark, d)).select("profile_id", "id", "place")


@query("j10_entity_options", f"WITH {ENTITIES} SELECT 0 AS part, 'all' AS id, 'All Universities' AS label UNION ALL SELECT 1, CAST(id AS VARCHAR), coalesce(CASE WHEN id % 2 = 0 THEN name END, CAST(id AS VARCHAR)) FROM entities")
def options(spark, d):
    e = entities(spark, d)
    return X.entity_options(e, e.where("id % 2 = 0").select("id", F.col("name").alias("label")))


@query("f6_lookup_entities", f"WITH {ENTITIES} SELECT id, name FROM entities WHERE id IN (SELECT o_custkey FROM orders)")
def lookup(spark, d):
    return X.lookup_entities(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), entities(spark, d)).select("id", "name")


@query("x2_added_ids", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def added(spark, d):
    o = table(spark, d, "orders")
    return X.added_ids(o.where("o_orderkey % 2 = 1").select("o_custkey"), o.where("o_orderkey % 2 = 0").select("o_custkey"))


@query("p32_verified_line", f"""WITH {ENTITIES} SELECT id, '[' || name || ' | ' || id || ' | VERIFIED] ' || array_to_string(list_filter([CASE WHEN city <> '' THEN 'city: ' || city END, CASE WHEN fee_amount <> 0 THEN 'tuition: ' || format('{{:,}}', fee_amount) || ' PKR ' || replace(fee_period, '_', ' ') END,
CASE WHEN min_eligibility IS NOT NULL THEN 'min eligibility: ' || min_eligibility || '%' END, CASE WHEN hostel IS NOT NULL THEN 'hostel: ' || CASE WHEN hostel THEN 'yes' ELSE 'no' END END, CASE WHEN has_scholarships THEN 'scholarships: yes' END], lambda x: x IS NOT NULL), '; ') AS line FROM entities""")
def verified(spark, d):
    return entities(spark, d).select("id", verified_line().alias("line"))


@query("j3_structured_snippet", f"""WITH {ENTITIES} SELECT id, array_to_string(list_filter([name, city, CASE WHEN province <> '' THEN 'province ' || province END, CASE WHEN fee_amount <> 0 THEN 'tuition ' || fee_amount || ' ' || fee_period END,
CASE WHEN min_eligibility IS NOT NULL THEN 'min eligibility ' || min_eligibility || '%' END, CASE WHEN has_scholarships THEN 'scholarships available' END, CASE WHEN hostel THEN 'hostel available' END], lambda x: x IS NOT NULL AND x <> ''), '. ') AS snippet FROM entities""")
def snippet(spark, d):
    return entities(spark, d).select("id", structured_snippet().alias("snippet"))


@query("p31_profile_query_text", f"""WITH {PROFILES}, t AS (SELECT profile_id, array_to_string(list_filter([CASE WHEN field_of_study <> '' THEN field_of_study || ' program' END, degree_level || ' degree eligibility', CASE WHEN budget_pkr_per_semester <> 0 THEN 'budget around ' || budget_pkr_per_semester || ' PKR per semester' END,
CASE WHEN len(preferred_cities) > 0 THEN 'located in ' || array_to_string(preferred_cities, ', ') WHEN preferred_province <> '' THEN 'located in ' || preferred_province END, CASE WHEN scholarship_required THEN 'scholarships and financial assistance available' END,
CASE WHEN academic_percentage <> 0 THEN 'academic percentage ' || academic_percentage END, CASE WHEN hostel_required THEN 'hostel accommodation available' END], lambda x: x IS NOT NULL), '. ') AS t FROM profiles)
SELECT profile_id, CASE WHEN t = '' THEN 'university admission eligibility and programs' ELSE t END AS query_text FROM t""")
def query_text(spark, d):
    from ..operators.retrieve import profile_query_text

    return profiles(spark, d).select("profile_id", profile_query_text().alias("query_text"))
