"""Queries of text rules, pages, records, profiles and intents over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..adapters import PROFILES, profiles, table
from ..functions import text as T
from ..operators.phrases import find
from ..operators import intents as I
from ..operators import pages as G
from ..operators import profiles as U
from ..sources import html as H
from ..sources import records as S
from .registry import query

# Words that the driver tables hold, in place of the default lists.
PHRASES, REPEATED, WORDS = ["license", "reserved"], ["tion", "ing"], ["license", "the", "with"]
_CLEAN = r"trim(regexp_replace(translate({0}, chr(8232) || chr(8233) || chr(65279) || chr(160), '    '), '[\s\p{{Z}}\x0B\x{{85}}]+', ' ', 'g'))"


def _times(x, w):
    return f"(len({x}) - len(replace({x}, '{w}', ''))) / {len(w)}"


def _garbled(x):
    return rf"(len(regexp_replace({x}, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) > len({x}) * 0.05::DOUBLE OR len({x}) - len(replace({x}, chr(65533), '')) > len({x}) * 0.02::DOUBLE)"


def _letters(x):
    return f"len(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def _page_noise(x):
    phrases = " OR ".join(f"contains(lower({x}), '{p}')" for p in PHRASES)
    times = " + ".join(_times(f"lower({x})", w) for w in REPEATED)
    return f"({phrases} OR (({times}) >= 2 AND len({x}) > 50) OR {_letters(x)} < greatest(10, len({x}) * 0.4::DOUBLE) OR {_garbled(x)})"


def _record_noise(x, phrases=PHRASES):
    phrases = " OR ".join(f"contains(lower({x}), '{p}')" for p in phrases)
    return f"(len({x}) < 20 OR {phrases} OR {_letters(x)} < len({x}) * 0.4::DOUBLE OR {_garbled(x)})"


_DOCS = f"d AS (SELECT doc_id, lang, source, text, {_CLEAN.format('text')} AS c FROM documents)"
_SENT = r"string_split(regexp_replace({0}, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))"
_LINES = "l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"


def _docs(spark, d):
    return table(spark, d, "documents")


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


@query("p1_clean_text", f"WITH {_DOCS} SELECT doc_id, len(c) AS n, md5(c) AS digest FROM d")
def clean(spark, d):
    c = T.clean_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("digest"))


@query("p2_noise_page_text", f"WITH {_LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_page_noise('line')}) AS noise FROM l GROUP BY 1")
def noise_page(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_noise_page_text(F.col("line"), PHRASES, REPEATED)).alias("noise"))


@query("p3_noise_record_text", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE {_record_noise('line')}) AS noise FROM l GROUP BY 1")
def noise_record(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.count_if(T.is_noise_record_text(F.col("line"), PHRASES)).alias("noise"))


@query("p4_noise_fee_label", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE contains(lower(line), 'license') OR contains(lower(line), 'reserved') OR len(line) - len(replace(line, chr(65533), '')) > len(line) * 0.02::DOUBLE) AS noise FROM l GROUP BY 1")
def noise_label(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.count_if(T.is_noise_fee_label(F.col("line"), PHRASES)).alias("noise"))


_SNIPS = f"s AS (SELECT doc_id, lang, source, list_filter({_SENT.format('c')}, lambda x: x <> '' AND NOT {_page_noise('x')}) AS s FROM d)"
_KEY = r"\b(?:" + "|".join(WORDS) + r")s?\b"


@query("p5_split_snippets", f"WITH {_DOCS}, {_SNIPS} SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def snippets(spark, d):
    s = T.split_snippets(F.col("text"), phrases=PHRASES, repeated=REPEATED)
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("p6_split_sentences", rf"WITH {_DOCS}, e AS (SELECT doc_id, list_filter({_SENT.format(r"regexp_replace(trim(regexp_replace(text, '[\s\p{Z}\x0B\x{85}]+', ' ', 'g')), '([.!?])([A-Z])', '\1 \2', 'g')")}, lambda x: trim(x) <> '') AS s FROM d) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM e")
def sentences(spark, d):
    return _docs(spark, d).select("doc_id", T.split_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("p8_keyword_snippets", f"WITH {_DOCS}, {_SNIPS}, k AS (SELECT doc_id, list_filter(s, lambda x: regexp_matches(lower(x), '{_KEY}'))[1:5] AS k FROM s) SELECT doc_id, len(k) AS n, md5(array_to_string(k, '|')) AS digest FROM k")
def keyword(spark, d):
    k = T.keyword_snippets(F.col("text"), WORDS, 5, phrases=PHRASES, repeated=REPEATED)
    return _docs(spark, d).select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|").cast("binary")).alias("digest"))





@query("p7_classify_page", "SELECT page_id, CASE WHEN a = '' THEN 'all' ELSE a END AS types FROM (SELECT page_id, array_to_string(list_filter([CASE WHEN contains(lower(url), '/p') THEN 'p' END, CASE WHEN contains(lower(url), '7') OR contains(lower(url), '9') THEN 'odd' END, CASE WHEN contains(lower(url), 'zzz') THEN 'never' END], lambda x: x IS NOT NULL), ',') AS a FROM pages)")
def classify(spark, d):
    types = {"p": ["/p"], "odd": ["7", "9"], "never": ["zzz"]}
    return table(spark, d, "pages").select("page_id", F.array_join(G.classify_page(F.col("url"), F.lit(""), types), ",").alias("types"))


@query("p9_category_fields", f"WITH {_DOCS}, {_SNIPS}, k AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN list_filter(s, lambda x: regexp_matches(lower(x), '\\b(?:the)s?\\b'))[1:8] ELSE [] END AS e, list_filter(s, lambda x: regexp_matches(lower(x), '\\b(?:with|was)s?\\b'))[1:6] AS h FROM s) SELECT doc_id, len(e) AS n_eligibility, len(h) AS n_hostel, md5(array_to_string(h, '|')) AS digest FROM k")
def fields(spark, d):
    words = {"eligibility_criteria": (["the"], 8), "hostel_info": (["with", "was"], 6)}
    typed = _docs(spark, d).withColumn("types", F.when(F.col("source").isin("src1", "src2"), F.array(F.lit("eligibility"))).otherwise(F.array(F.lit("fee"))))
    out = G.extract_category_fields(typed, words, content="text", phrases=PHRASES, repeated=REPEATED)
    return out.select("doc_id", F.size("eligibility_criteria").cast("long").alias("n_eligibility"), F.size("hostel_info").cast("long").alias("n_hostel"), F.md5(F.array_join("hostel_info", "|").cast("binary")).alias("digest"))


@query("p16_numeric_range", r"WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\d{1,3}[,\d]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DECIMAL(38, 0))) AS v FROM documents) SELECT doc_id, CAST(list_min(v) AS VARCHAR) AS low, CAST(list_max(v) AS VARCHAR) AS high FROM n WHERE len(v) > 0")
def numbers(spark, d):
    return _docs(spark, d).select("doc_id", T.numeric_range(F.col("text")).alias("r")).where("r IS NOT NULL").select("doc_id", F.col("r.amount_min").cast("string").alias("low"), F.col("r.amount_max").cast("string").alias("high"))


@query("p19_max_percentage", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN greatest(c_custkey % 101, 40) WHEN c_custkey % 101 = 0 THEN NULL ELSE c_custkey % 101 END AS DOUBLE) AS pct FROM customer")
def percentage(spark, d):
    k = F.col("c_custkey")
    said = F.array(F.concat(F.lit("at least "), (k % 101).cast("string"), F.lit("% in class")), F.when(k % 3 == 0, "40% minimum marks").otherwise("weightage of tests 90%"))
    return table(spark, d, "customer").select("c_custkey", T.max_percentage(said).alias("pct"))


@query("p20_named_tests", r"SELECT doc_id, nullif(array_to_string(list_filter([CASE WHEN regexp_matches(text, '\blicense\b', 'i') THEN 'license' END, CASE WHEN regexp_matches(text, '\bthe\b', 'i') THEN 'the' END, CASE WHEN regexp_matches(text, '\bder\b', 'i') THEN 'der' END], lambda x: x IS NOT NULL), ', '), '') AS tests FROM documents")
def tests(spark, d):
    return _docs(spark, d).select("doc_id", T.named_tests(F.array("text"), ["license", "the", "der"]).alias("tests"))


_ITEMS = r"i AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}\x0B\x{85}]+', ' ', 'g'))) AS a FROM documents)"


@query("p21_string_list", f"WITH {_ITEMS}, f AS (SELECT doc_id, list_filter(a, lambda x: x <> '' AND NOT {_record_noise('x')}) AS a FROM i) SELECT doc_id, len(list_distinct(a)) AS n, md5(array_to_string(list_sort(list_distinct(a)), '|')) AS digest FROM f")
def string_list(spark, d):
    a = T.normalize_string_list(F.split("text", "\n"), PHRASES)
    return _docs(spark, d).select("doc_id", a.alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("a"), "|").cast("binary")).alias("digest"))


@query("p22_program_list", "SELECT p_brand, count(DISTINCT trim(p_name)) AS n, md5(string_agg(DISTINCT trim(p_name), '|' ORDER BY trim(p_name))) AS digest FROM part GROUP BY 1")
def program_list(spark, d):
    each = F.explode(T.normalize_program_list(F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")))))
    a = table(spark, d, "part").select("p_brand", each.alias("name")).distinct().groupBy("p_brand").agg(F.collect_list("name").alias("a"))  # repeats go before a brand meets
    return a.select("p_brand", F.size("a").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("a"), "|").cast("binary")).alias("digest"))


@query("p23_filter_marked", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT contains(lower(x), 'the') AND NOT contains(lower(x), 'license'))) AS n FROM documents")
def marked(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.filter_marked_items(F.split("text", "\n"), ["the", "license"])).cast("long").alias("n"))


@query("p24_tri_state", "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS housing FROM customer")
def tri_state(spark, d):
    k = F.col("c_custkey")
    said = F.when(k % 4 == 1, F.array(F.lit("runs an official girls hostel; not available elsewhere"))).when(k % 4 == 2, F.array(F.lit("housing is not available"))).when(k % 4 == 3, F.array(F.lit("hostels are near"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", T.tri_state_evidence(said).alias("housing"))


@query("p25_entity_slug", r"SELECT p_partkey, trim(regexp_replace(lower('-' || p_name || ' / ' || p_type || ' '), '[\s\-/]+', '_', 'g'), '_') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.entity_slug(F.concat(F.lit("-"), "p_name", F.lit(" / "), "p_type", F.lit(" "))).alias("slug"))


_LEVELS = [("A", r"(?i)\bthe\b"), ("B", r"(?i)\blicense\b"), ("C", r"(?i)\bder\b")]


@query("p26_degree_levels", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\bthe\b', 'i') THEN 'A' END, CASE WHEN regexp_matches(text, '\blicense\b', 'i') THEN 'B' END, CASE WHEN regexp_matches(text, '\bder\b', 'i') THEN 'C' END], lambda x: x IS NOT NULL), ',') AS levels FROM documents")
def levels(spark, d):
    return _docs(spark, d).select("doc_id", T.degree_levels(F.col("text"), _LEVELS).alias("levels"))


@query("p27_sanitize_int", "SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n FROM customer")
def digits(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.sanitize_int(F.col("c_name")).alias("n"))


@query("p28_program_to_field", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS field FROM part")
def program_field(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" admission"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("BS (Honors) in ("), "p_name", F.lit(")"))).otherwise(F.concat(F.lit("Bachelor of Science "), "p_name"))
    return table(spark, d, "part").select("p_partkey", T.program_to_field(raw).alias("field"))


@query("p29_title", r"WITH t AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '[\s\p{Z}\x0B\x{85}]+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN 'New Chat' WHEN len(t) <= 72 THEN t ELSE regexp_replace(t[1:71], '[ ,;:]+$', '') || '…' END AS title FROM t")
def title(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.title_from_message(F.col("text")).alias("title"))


@query("p33_natural_join", "WITH a AS (SELECT c_custkey, list_filter([c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'x' END, CASE WHEN c_custkey % 3 = 0 THEN c_name END, ''], lambda v: v IS NOT NULL AND v <> '') AS a FROM customer) SELECT c_custkey, CASE len(a) WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' and ' || a[2] ELSE array_to_string(a[1:len(a) - 1], ', ') || ', and ' || a[len(a)] END AS told FROM a")
def joined(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.natural_join(F.array("c_mktsegment", F.when(k % 2 == 0, "x"), F.when(k % 3 == 0, F.col("c_name")), F.lit(""))).alias("told"))


@query("p34_normalize_role", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE role END AS role FROM conversations")
def role(spark, d):
    raw = F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, "Human").otherwise("USER")).when(F.col("role") == "assistant", F.when(F.col("turn") % 2 == 0, " ai").otherwise("Assistant")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_role(raw).alias("role"))


@query("p10_line_predicates", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(lower(line), '\b(?:ms|bs)\b')) AS programs, count(*) FILTER (WHERE regexp_matches(line, '\b(total|hours|category|grade)\b', 'i')) AS catalog, count(*) FILTER (WHERE regexp_matches(lower(line), '\b(rs|fee|amount)\b')) AS cost FROM l GROUP BY 1")
def predicates(spark, d):
    line = F.col("line")
    return _lines(spark, d).groupBy("doc_id").agg(F.count_if(G.has_program_indicator(line)).alias("programs"), F.count_if(G.is_catalog_line(line)).alias("catalog"), F.count_if(G.has_cost_info(line)).alias("cost"))


@query("s3_html_to_page_record", r"""WITH b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<nav\b.*?</nav\s*>', ' ', 'gis'), '<footer\b.*?</footer\s*>', ' ', 'gis'), '<header\b.*?</header\s*>', ' ', 'gis'), '<noscript\b.*?</noscript\s*>', ' ', 'gis') AS bare FROM pages),
p AS (SELECT page_id, url, regexp_extract(html, '<title[^>]*>(.*?)</title\s*>', 1, 'is') AS t, regexp_extract(bare, '<article\b[^>]*>(.*?)</article\s*>', 1, 'is') AS a FROM b),
c AS (SELECT page_id, url, t, regexp_replace(regexp_replace(a, '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'gs') AS a FROM p),
e AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t, replace(replace(replace(replace(a, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS a FROM c)
SELECT page_id, CASE WHEN trim(t) = '' THEN url ELSE trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g')) END AS title, len(trim(regexp_replace(a, '[\s\p{Z}]+', ' ', 'g'))) AS n, md5(trim(regexp_replace(a, '[\s\p{Z}]+', ' ', 'g'))) AS digest FROM e""")
def html_record(spark, d):
    return H.html_to_page_record(table(spark, d, "pages")).select("page_id", "title", F.length("content").cast("long").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("s4_html_tables")
def html_tables(spark, d):
    """The driver's pages hold no tables: each gets one, made from its address."""
    made = F.concat("html", F.lit("<div class='panel'><h3>Fees</h3>see<table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>"), "url", F.lit("</td><td>1</td></tr></table></div>"))
    return H.extract_html_tables(table(spark, d, "pages").select("page_id", made.alias("html"))).select("page_id", "kind", "idx", "row_idx", "title", F.array_join("cells", "|").alias("cells"), F.array_join("headers", "|").alias("headers"))


@query(
    "p14_real_header",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*') AS ws FROM l)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(ws) > 0 AND len(list_filter(ws, lambda x: regexp_matches(x, '{G.rules.AMOUNT_LIKE}'))) <= len(ws) * 0.3::DOUBLE) AS n_real
    FROM w GROUP BY doc_id""",
)
def real_headers(spark, d):
    """The words with digits of every line as the cells of a header."""
    words = F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"), F.lit(0))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", G.is_real_header(words).cast("int").alias("real")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("real").alias("n_real"))


@query(
    "p17_normalize_fees",
    f"""WITH l AS (SELECT doc_id, {_CLEAN.format("source")} AS label, unnest(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN.format("x")})) AS value FROM documents),
    k AS (SELECT doc_id, label || ': ' || value AS fee FROM l WHERE label <> '' AND value <> '' AND NOT ({_record_noise("label", G.rules.RECORD_NOISE)} AND {_record_noise("value", G.rules.RECORD_NOISE)}))
    SELECT d.doc_id, count(k.fee) AS n_fees, coalesce(sum(len(k.fee)), 0)::BIGINT AS length FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
)
def fee_entries(spark, d):
    """Every line of a text as a fee's value under the name of its source."""
    docs = table(spark, d, "documents")
    fees = G.normalize_fee_entries(F.transform(F.split("text", "\n"), lambda x: F.struct(F.col("source").alias("label"), x.alias("value"))))
    sizes = F.transform(F.col("fees"), lambda f: F.length(f["label"]) + F.length(f["value"]) + 2)
    return docs.select("doc_id", fees.alias("fees")).select("doc_id", F.size("fees").cast("long").alias("n_fees"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("length"))


@query("s8_select_pdf_urls", "SELECT page_id FROM pages WHERE contains(lower(url), '1')")
def pdf_urls(spark, d):
    return S.select_pdf_urls(table(spark, d, "pages"), needle="1").select("page_id")


@query("s9_content_address", r"WITH n AS (SELECT DISTINCT split_part(split_part(url, '?', 1), '/', -1) AS name, sha256(html) AS sha256 FROM pages), m AS (SELECT CASE WHEN name = '' THEN 'download' ELSE name END AS name, sha256 FROM n) SELECT name, sha256, regexp_replace(name, '\.[^.]*$', '') || '-' || sha256[1:8] || regexp_extract(name, '(\.[^.]*)$', 1) AS file_name FROM m")
def address(spark, d):
    return S.content_address(table(spark, d, "pages"), content="html")


@query("s10_flatten_record", r"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents) SELECT doc_id AS university_id, array_to_string(a, ' ')[1:2000] AS eligibility_text, len(a) > 3 AS has_scholarships, ('fee: ' || doc_id || ' line: ' || len(a))[1:4000] AS fee_text FROM l")
def flatten(spark, d):
    a = F.filter(F.split("text", "\n"), lambda x: x != "")
    fee = lambda k, v: F.struct(F.lit(k).alias("label"), v.cast("string").alias("value"))
    r = _docs(spark, d).select(F.col("doc_id").alias("stem"), F.lit("u").alias("university"), F.col("source").alias("location"), F.lit("p").alias("province"), a.alias("eligibility_criteria"), a.alias("test_pattern"), F.slice(a, 4, 100).alias("scholarships"), a.alias("hostel_info"), F.struct(F.array(fee("fee", F.col("doc_id")), fee("line", F.size(a))).alias("fees")).alias("fee_structure"), a.alias("offered_courses"), a.alias("source_pages"))
    return S.flatten_entity_record(r).select("university_id", "eligibility_text", "has_scholarships", "fee_text")


@query("s11_upsert", "SELECT o_custkey AS k, arg_max(o_orderkey, 3 - o_orderkey % 3) AS v FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderkey % 3) GROUP BY 1")
def upsert(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).alias("b")).agg(F.max("o_orderkey").alias("v"))
    part = lambda i: o.where(F.col("b") == i).select("k", "v")
    return S.upsert_entities(part(2), [part(1), part(0)], "k")


@query("s12_evolve_schema", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS size FROM region")
def evolve(spark, d):
    schema = StructType([StructField("r_name", StringType()), StructField("note", StringType()), StructField("size", LongType())])
    return S.evolve_schema(table(spark, d, "region"), schema)


@query("s13_fallback", "SELECT s_suppkey, s_name FROM supplier")
def fallback(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return S.read_entities_with_fallback(supplier.where("s_suppkey < 0"), supplier)


@query("x1_union_pages", "SELECT page_id, url, html AS content FROM pages UNION ALL SELECT item_id, 'manual://' || item_id, text FROM benchmark")
def union(spark, d):
    manual = table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"), F.concat(F.lit("manual://"), F.col("item_id").cast("string")).alias("url"), F.col("text").alias("content"))
    return G.union_pages(table(spark, d, "pages").select("page_id", "url", F.col("html").alias("content")), manual)


@query("x3_ordered_distinct", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY 1")
def distinct(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.array("o_orderpriority"))
    out = G.aggregate_pages(o, "o_custkey", "o_orderkey", ["a"])
    return out.select("o_custkey", F.size("a").cast("long").alias("n"), F.col("a")[0].alias("first"))


@query("a1_aggregate_pages", r"WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT source, line, min(doc_id * 10000000 + i) AS o FROM l GROUP BY 1, 2) SELECT source, row_number() OVER (PARTITION BY source ORDER BY o) AS place, line FROM f")
def aggregate(spark, d):
    return G.aggregate_items(_docs(spark, d).withColumn("a", F.split("text", "\n")), "source", "doc_id", "a").withColumnRenamed("item", "line")


@query("a2_official_site", r"WITH h AS (SELECT page_id % 40 AS k, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS h, page_id FROM pages), c AS (SELECT k, h, count(*) AS n, min(page_id) AS f FROM h WHERE h <> '' GROUP BY 1, 2) SELECT k, 'https://' || h AS site FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1")
def site(spark, d):
    return G.official_site(table(spark, d, "pages").withColumn("k", F.col("page_id") % 40), "k", order="page_id")


_ALIASES = {"w_the": ["the", "of the"], "w_was": ["was"], "w_with": ["with", "this"], "w_and": ["and"]}
# Word borders of all letters: DuckDB's \b knows ASCII letters only. Words are put between two marks first.
_MARKED = r"regexp_replace(lower(text), '([\p{L}\p{M}\p{Nd}_]+)', chr(1) || '\1' || chr(2), 'g')"
_MATCH = rf"list_transform(list_transform(regexp_extract_all({_MARKED}, '\x01(?:of\x02 \x01the|this|with|the|was|and)\x02'), lambda m: replace(replace(m, chr(1), ''), chr(2), '')), lambda a: CASE WHEN a IN ('the', 'of the') THEN 'w_the' WHEN a = 'was' THEN 'w_was' WHEN a IN ('with', 'this') THEN 'w_with' ELSE 'w_and' END)"
_M = f"m AS (SELECT *, {_MATCH} AS ms FROM conversations)"


def _messages(spark, d):
    return table(spark, d, "conversations")


@query("i1_detect_entities", f"WITH {_M} SELECT conv_id, turn, len(list_distinct(ms)) AS n, ms[1] AS first, array_to_string(list_sort(list_distinct(ms)), ',') AS ids FROM m")
def detect(spark, d):
    ids = I.detect_entities(F.col("text"), _ALIASES)
    return _messages(spark, d).select("conv_id", "turn", ids.alias("a")).select("conv_id", "turn", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).alias("first"), F.array_join(F.array_sort("a"), ",").alias("ids"))


@query("i1_detect_many_aliases", r"""WITH a AS (SELECT DISTINCT phrase FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_]+')) AS phrase FROM benchmark) WHERE length(phrase) >= 4),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_]+') AS w FROM documents))
SELECT doc_id, count(*) AS n, count(DISTINCT word) AS named, arg_min(word, i) AS first FROM w JOIN a ON word = phrase GROUP BY 1""")
def detect_many(spark, d):
    """Whole words of the benchmark, some thousand aliases, in every text, by one automaton."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{Nd}_]+"), F.lit(0)))
    aliases = table(spark, d, "benchmark").select(words.alias("phrase")).where(F.length("phrase") >= 4)
    found = find(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), aliases, "words")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("phrase").alias("named"), F.min_by("phrase", "start").alias("first"))


@query("i2_focus_entities", f"WITH {_M} SELECT conv_id, turn, CASE WHEN len(list_distinct(ms)) >= 2 AND contains(text, ',') THEN array_to_string(list_sort(list_distinct(ms)), ',') ELSE '' END AS ids FROM m")
def focus(spark, d):
    ids = I.focus_entities(F.col("text"), _ALIASES)
    return _messages(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(ids), ",").alias("ids"))


@query("i3_category_hints", "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(text), 'tion') THEN 'a' END, CASE WHEN contains(lower(text), 'zzz') OR contains(lower(text), 'and') THEN 'b' END], lambda x: x IS NOT NULL), ',') AS hints FROM conversations")
def hints(spark, d):
    return _messages(spark, d).select("conv_id", "turn", F.array_join(I.category_hints(F.col("text"), {"a": ["tion"], "b": ["zzz", "and"]}), ",").alias("hints"))


# Words that the conversations hold, in place of those of the rules.
_INTENTS = {
    "why": [r"\bwas\b.*\bwith\b", r"\bby\b.*\bbe\b"], "rerank": r"(?i)\b(this|from)\b", "followup": r"(?i)\b(for|are)\b", "question": r"(?i)\b(is|on)\b",
    "sign": r"(?i)\?|\bit\b|\bthat\b", "chart": ["of the", "is to"], "focus": r"(?i)\b(as|at)\b",
}


_B, _E, _GAP = r"(^|[^\p{L}\p{M}\p{Nd}_])", r"($|[^\p{L}\p{M}\p{Nd}_])", r"[^\p{L}\p{M}\p{Nd}_\n](.*[^\p{L}\p{M}\p{Nd}_\n])?"
_FLAGS = rf"""WITH {_M}, t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t, lower(trim(coalesce(text, ''))) AS low, coalesce(len(list_distinct(ms)), 0) AS named FROM m),
w AS (SELECT *, named >= 2 AND (contains(t, ',') OR regexp_matches(t, '(?i){_B}(as|at){_E}')) AS focused, regexp_matches(low, '{_B}was{_GAP}with{_E}|{_B}by{_GAP}be{_E}') AS asks_why_ranked,
  regexp_matches(t, '(?i){_B}(this|from){_E}') AS asks_rerank, regexp_matches(t, '(?i){_B}(for|are){_E}') AS follow, contains(low, 'of the') OR contains(low, 'is to') AS asks_about_chart,
  regexp_matches(t, '(?i)\?|{_B}(it|that){_E}') AS has_question_sign FROM t),
f AS (SELECT *, NOT focused AND NOT (asks_rerank AND NOT follow) AND (follow OR asks_why_ranked) AS is_followup,
  t <> '' AND NOT asks_about_chart AND (contains(t, '?') OR regexp_matches(t, '(?i){_B}(is|on){_E}')) AS is_question FROM w)"""


@query("i4_message_intents", f"{_FLAGS} SELECT conv_id, turn, asks_why_ranked, asks_rerank, is_followup, is_question, has_question_sign, asks_about_chart FROM f")
def message_intents(spark, d):
    flags = I.message_intents(F.col("text"), _ALIASES, _INTENTS)
    return _messages(spark, d).select("conv_id", "turn", *[v.alias(k) for k, v in flags.items()])


@query("i5_resolve_entity", f"WITH {_M}, r AS (SELECT conv_id, turn, role, ms, last_value(CASE WHEN role = 'assistant' THEN ms END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply FROM m) SELECT conv_id, turn, coalesce(ms[1], reply[1]) AS entity FROM r WHERE role = 'user'")
def resolve(spark, d):
    return I.resolve_entity(_messages(spark, d), _ALIASES)


@query("i6_route_turn", f"""{_FLAGS} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND (focused OR (asks_rerank AND NOT is_followup)) THEN 'refine'
  WHEN asks_about_chart OR (conv_id % 2 = 0 AND (is_followup OR is_question)) OR (conv_id % 3 = 0 AND is_question) THEN 'answer_question' ELSE 'keep' END AS route FROM f""")
def route(spark, d):
    return _messages(spark, d).select("conv_id", "turn", I.route_turn(F.col("text"), _ALIASES, F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0, _INTENTS).alias("route"))


@query("i7_last_message_by_role", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY 1")
def last_messages(spark, d):
    return I.last_message_by_role(_messages(spark, d))


_P = f"WITH {PROFILES}"


@query("u1_sanitize_profile", "SELECT c_custkey, CASE WHEN c_acctbal / 50 BETWEEN 0 AND 100 THEN c_acctbal / 50 END AS academic_percentage, CASE WHEN c_acctbal * 10000 > 0 AND c_acctbal * 10000 <= 50000000 THEN CAST(floor(c_acctbal * 10000) AS BIGINT) END AS budget_pkr_per_semester FROM customer")
def sanitize(spark, d):
    raw = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("academic_percentage"), (F.col("c_acctbal") * 10000).alias("budget_pkr_per_semester"))
    return U.sanitize_profile(raw)


@query("u2_merge_updates", "SELECT user_id AS profile_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS field, arg_max(value, event_id) FILTER (WHERE value > 50) AS score FROM events GROUP BY 1")
def merge(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("field"), F.when(F.col("value") > 50, F.col("value")).alias("score"))
    return U.merge_profile_updates(e, ["field", "score"])


_MISSING = "array_to_string(list_filter([CASE WHEN field_of_study = '' THEN 'field_of_study' END, CASE WHEN budget_pkr_per_semester IS NULL THEN 'budget_pkr_per_semester' END, CASE WHEN preferred_province IS NULL THEN 'preferred_province' END, CASE WHEN academic_percentage IS NULL THEN 'academic_percentage' END, CASE WHEN current_education_level IS NULL THEN 'current_education_level' END], lambda x: x IS NOT NULL), ',')"


@query("u3_missing_required", f"{_P} SELECT profile_id, {_MISSING} AS missing, {_MISSING} = '' AS ready FROM profiles")
def missing(spark, d):
    return U.missing_required(profiles(spark, d)).select("profile_id", F.array_join("missing", ",").alias("missing"), "ready")


_EARNED = "5 + CASE WHEN current_education_level IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN academic_percentage IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN field_of_study <> '' THEN 15 ELSE 0 END + CASE WHEN budget_pkr_per_semester IS NOT NULL THEN 10 ELSE 0 END + 5 + 5 + 10 + CASE WHEN preferred_province IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN priority_focus IS NOT NULL THEN 5 ELSE 0 END"
_PCT = f"CAST(round_even(({_EARNED}) * 100.0::DOUBLE / 110, 0) AS INTEGER)"


@query("u4_completeness", f"{_P} SELECT profile_id, {_PCT} AS completeness_pct FROM profiles")
def complete(spark, d):
    return U.completeness(profiles(spark, d)).select("profile_id", "completeness_pct")


@query("u5_status_label", f"{_P}, c AS (SELECT profile_id, {_PCT} AS pct FROM profiles) SELECT profile_id, CASE WHEN pct >= 85 THEN 'Complete' WHEN pct >= 50 THEN 'In Progress' ELSE 'Getting Started' END AS status FROM c")
def status(spark, d):
    return U.completeness(profiles(spark, d)).select("profile_id", U.status_label(F.col("completeness_pct")).alias("status"))


_STAGE = "CASE current_education_level WHEN 'grade 9' THEN 0 WHEN 'matric done' THEN 1 WHEN 'Intermediate completed' THEN 2 WHEN 'completed BS degree' THEN 3 END"


@query("u6_education_stage", f"{_P} SELECT profile_id, {_STAGE} AS stage FROM profiles")
def stage(spark, d):
    return profiles(spark, d).select("profile_id", U.education_stage(F.col("current_education_level")).alias("stage"))


@query("u7_eligibility_block", f"{_P} SELECT profile_id, coalesce({_STAGE} < CASE degree_level WHEN 'Bachelor' THEN 2 WHEN 'Master' THEN 3 ELSE 4 END, false) AS blocked FROM profiles")
def blocked(spark, d):
    return profiles(spark, d).select("profile_id", U.eligibility_block(F.col("degree_level"), F.col("current_education_level")).alias("blocked"))


@query("u8_out_of_scope", f"{_P} SELECT profile_id, CASE WHEN len(preferred_cities) > 0 THEN NOT contains(lower(preferred_cities[1]), 'nation_1') ELSE preferred_province IS NOT NULL AND lower(preferred_province) <> 'asia' END AS out_of_scope FROM profiles")
def scope(spark, d):
    return profiles(spark, d).select("profile_id", U.out_of_scope_region(F.col("preferred_cities"), F.col("preferred_province"), "nation_1", "asia").alias("out_of_scope"))
