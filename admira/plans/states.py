"""Queries of state folds, conversations, chunks and retrieval over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import ENTITIES, EVENT_LOG, PROFILES, event_log, profiles, table
from ..operators import chunks as C
from ..operators import profiles as U
from ..operators import retrieve as V
from ..sources import versioned
from ..sources.folders import shared_dir
from ..streaming import keyed as K
from ..streaming import state as E
from .dashboard import _SHORT
from .registry import query


def _messages(spark, d):
    return table(spark, d, "conversations")


@query("e1_shortlist_state", f"WITH {_SHORT} SELECT profile_id, id, created_at, seq FROM shortlist")
def shortlist(spark, d):
    return E.shortlist_state(event_log(spark, d))


_CONV = "c AS (SELECT event_id AS seq, ts, user_id % 40 AS conv, user_id AS owner, CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'touch' END AS kind, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '  ' ELSE ' t' || event_id END AS title, event_type AS filter FROM events)"
_CSTATE = f"""{_CONV}, r AS (SELECT *, CASE kind WHEN 'rename' THEN coalesce(nullif(trim(title)[1:120], ''), 'New Chat') WHEN 'upsert' THEN title END AS nt, CASE kind WHEN 'upsert' THEN true WHEN 'delete' THEN false END AS alive FROM c),
cs AS (SELECT conv, coalesce(arg_max(nt, seq) FILTER (WHERE nt IS NOT NULL), 'New Chat') AS title, arg_max(filter, seq) FILTER (WHERE kind = 'upsert') AS filter, coalesce(NOT arg_max(alive, seq) FILTER (WHERE alive IS NOT NULL), false) AS is_deleted, max(ts) AS updated_at FROM r GROUP BY 1)"""


def _conv_events(spark, d):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "upsert").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "error", "delete").otherwise("touch")
    title = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "  ").otherwise(F.concat(F.lit(" t"), k.cast("string")))
    return table(spark, d, "events").select(k.alias("seq"), "ts", (F.col("user_id") % 40).alias("conv"), kind.alias("kind"), title.alias("title"), F.col("event_type").alias("filter"))


@query("e2_conversation_state", f"WITH {_CSTATE} SELECT * FROM cs")
def conversation(spark, d):
    return E.conversation_state(_conv_events(spark, d))


@query("f5_active_conversations", f"WITH {_CSTATE} SELECT conv, title FROM cs WHERE NOT is_deleted")
def active(spark, d):
    return E.active_conversations(E.conversation_state(_conv_events(spark, d))).select("conv", "title")


@query("w5_list_conversations", f"WITH {_CSTATE} SELECT conv, conv % 7 AS owner, CAST(row_number() OVER (PARTITION BY conv % 7 ORDER BY updated_at DESC, conv) AS INTEGER) AS place FROM cs QUALIFY place <= 3")
def listed(spark, d):
    state = E.conversation_state(_conv_events(spark, d)).withColumn("owner", F.col("conv") % 7)
    return E.list_conversations(state, "owner", 3).select("conv", "owner", "place")


_TITLE = r"CASE WHEN f = '' THEN 'New Chat' WHEN len(f) <= 72 THEN f ELSE regexp_replace(f[1:71], '[ ,;:]+$', '') || '…' END"


@query("e3_auto_title", rf"WITH f AS (SELECT conv_id, regexp_replace(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '[\s\p{{Z}}\x0B\x{{85}}]+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g') AS f FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'own' WHEN f IS NULL THEN 'New Chat' ELSE {_TITLE} END AS title FROM f")
def auto_title(spark, d):
    m = _messages(spark, d)
    convs = m.select("conv_id").distinct().withColumn("title", F.when(F.col("conv_id") % 3 == 0, "own").otherwise("New Chat"))
    return E.auto_title(m, convs)


@query("e4_append_messages", "SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE trim(text) <> '' AND conv_id % 2 = 0")
def append(spark, d):
    m = _messages(spark, d).select("conv_id", "turn", F.concat(F.lit(" "), "text", F.lit("  ")).alias("text"))
    return E.append_messages(m, m.where("conv_id % 2 = 0").select("conv_id").distinct()).select("conv_id", "turn", F.col("text"))


@query("e5_purge_conversation", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 1")
def purge(spark, d):
    m = _messages(spark, d).select("conv_id", "turn")
    return E.purge_conversations(m, m.where("conv_id % 3 = 1").select("conv_id"))


@query("e6_latest_recommendations", f"WITH {EVENT_LOG} SELECT student, arg_max(entity, seq) AS entity, arg_max(event_type, seq) AS event_type FROM event_log GROUP BY 1")
def latest(spark, d):
    return E.latest_by_key(event_log(spark, d), "student", ["entity", "event_type"])


_PEV = "p AS (SELECT user_id AS student, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_type END AS name, CASE WHEN value > 40 THEN value END AS academic_percentage FROM events)"


_PROFILE_SQL = f"WITH {_PEV}, s AS (SELECT student, arg_max(kind, seq) AS kind, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name, arg_max(coalesce(academic_percentage, -1), seq) AS a FROM p GROUP BY 1) SELECT student, name, nullif(a, -1) AS academic_percentage, CAST(round_even(((CASE WHEN name IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN a <> -1 THEN 15 ELSE 0 END)) * 100.0::DOUBLE / 110, 0) AS INTEGER) AS completeness_pct FROM s WHERE kind <> 'delete'"


def _profile_events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("student"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("name"), F.when(F.col("value") > 40, F.col("value")).alias("academic_percentage"))


@query("e7_profile_state", _PROFILE_SQL)
def profile(spark, d):
    return E.profile_state(_profile_events(spark, d), ["name", "academic_percentage"])


@query("e8_ensure_students", "SELECT DISTINCT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'known' || user_id ELSE sha256(CAST(user_id AS VARCHAR)) END AS id FROM events")
def students(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("session_id"))
    known = s.where("session_id % 2 = 0").distinct().withColumn("id", F.concat(F.lit("known"), F.col("session_id").cast("string")))
    return E.ensure_students(s, known)


def _streamed(spark, log, fold):
    """The state table that a stream of the log leaves, in three batches of files."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log.repartitionByRange(3, "seq").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    K.stream_state(stream, fold, f"{base}/state", f"{base}/offsets").awaitTermination()
    return K.read_state(spark, fold, f"{base}/state")


@query("e9_stream_state", f"WITH {_SHORT} SELECT profile_id, id, created_at, seq FROM shortlist")
def streamed(spark, d):
    return _streamed(spark, event_log(spark, d).select("seq", "ts", "student", "entity", "kind"), K.shortlist_fold())


@query("e9_stream_conversations", f"WITH {_CSTATE} SELECT * FROM cs")
def streamed_conversations(spark, d):
    return _streamed(spark, _conv_events(spark, d), K.conversation_fold())


@query("e9_stream_profiles", _PROFILE_SQL)
def streamed_profiles(spark, d):
    return _streamed(spark, _profile_events(spark, d), K.profile_fold("student long", "name string, academic_percentage double"))


@query("s11_bucketed_upserts", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def upserts(spark, d):
    """The last order of each customer, merged in three commits that overlap."""
    path = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for commit, part in enumerate(("o_orderkey % 3 <> 0", "o_orderkey % 3 <> 1", "o_orderkey % 3 <> 2")):
        versioned.upsert(orders.where(part), path, ["o_custkey"], "o_orderkey", commit)
    return versioned.read(spark, path, "o_custkey long, o_orderkey long, o_totalprice double")


@query("w6_ordered_messages", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY -turn % 3, turn) AS INTEGER) AS place FROM conversations")
def ordered(spark, d):
    return E.ordered_messages(_messages(spark, d).withColumn("ts", -F.col("turn") % 3)).select("conv_id", "turn", "place")


@query("j8_owned_messages", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 2 AND conv_id % 3 <> 0")
def owned(spark, d):
    m = _messages(spark, d).select("conv_id", "turn")
    convs = m.select("conv_id").distinct().withColumn("owner", F.col("conv_id") % 5).withColumn("is_deleted", F.col("conv_id") % 3 == 0)
    return E.owned_messages(m, convs, 2)


@query("j9_agent_context", f"WITH {PROFILES}, {_SHORT}, s AS (SELECT profile_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS saved_ids, count(*) AS n_saved FROM shortlist GROUP BY 1), r AS (SELECT o_custkey AS profile_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey FROM orders), q AS (SELECT profile_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS recommended, count(*) AS n_recommended FROM r WHERE k <= 3 GROUP BY 1) SELECT p.profile_id, coalesce(saved_ids, '') AS saved_ids, coalesce(n_saved, 0) AS n_saved, coalesce(recommended, '') AS recommended, coalesce(n_recommended, 0) AS n_recommended FROM profiles p LEFT JOIN s ON p.profile_id = s.profile_id LEFT JOIN q ON p.profile_id = q.profile_id")
def context(spark, d):
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("profile_id").orderBy("id"))
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("id")).withColumn("rank", rank).where("rank <= 3")
    p = U.missing_required(U.completeness(profiles(spark, d)))
    return E.agent_context(p, E.shortlist_state(event_log(spark, d)), ranked).select("profile_id", "saved_ids", "n_saved", "recommended", "n_recommended")


def _chunks_of(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


@query("c1_pack_units")
def pack_units(spark, d):
    units = F.filter(F.split("text", "\n"), lambda x: x != "")
    return _chunks_of(spark, d).select("doc_id", F.posexplode(C.pack_units(units)).alias("i", "chunk"))


@query("c2_chunk_text")
def chunk_text(spark, d):
    return _chunks_of(spark, d).select("doc_id", F.posexplode(C.chunk_text(F.col("text"))).alias("i", "chunk"))


@query("c3_chunk_items")
def chunk_items(spark, d):
    return _chunks_of(spark, d).select("doc_id", F.posexplode(C.chunk_items(F.split("text", "\n"))).alias("i", "chunk"))


def _records(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    fee = F.struct(F.struct(F.lit("fee").alias("label"), F.col("doc_id").cast("string").alias("value")).alias("f"))
    return _chunks_of(spark, d).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("stem"), F.col("source").alias("university"), F.col("lang").alias("location"), F.lit("p").alias("province"), (F.col("doc_id") % 2 == 0).alias("is_public"), F.array(F.col("source")).alias("source_pages"), lines.alias("eligibility_criteria"), lines.alias("test_pattern"), lines.alias("scholarships"), F.array("lang").alias("offered_courses"), F.struct(F.array(fee["f"]).alias("fees")).alias("fee_structure"), F.array().cast("array<string>").alias("hostel_info"))


@query("c4_build_chunks")
def build_chunks(spark, d):
    return C.build_chunks(_records(spark, d)).select("chunk_id", "category", "text")


@query("c5_chunk_metadata")
def metadata(spark, d):
    return C.build_chunks(_records(spark, d)).select("chunk_id", "metadata.university_id", "metadata.city", "metadata.degree_levels", "metadata.source_pages", "metadata.length_chars", "metadata.is_public")


@query("c6_embed")
def embed(spark, d):
    made = C.embed(_chunks_of(spark, d).select("doc_id", "text"))
    return made.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query("s15_vector_table", "SELECT doc_id, label FROM documents JOIN embeddings ON doc_id = vec_id")
def vector_table(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    chunks = _chunks_of(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return C.build_vector_table(chunks, vectors).join(labels, "chunk_id").select(F.col("chunk_id").alias("doc_id"), "label")


_DIST = "list_sum(list_transform(list_zip(q, v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("entity"), (F.col("vec_id") % 4).cast("string").alias("category"))


@query("w1_knn", f"WITH q AS (SELECT vec_id AS question_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0) SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY dist, id) AS INTEGER) AS rank FROM (SELECT question_id, vec_id AS id, {_DIST} AS dist FROM q CROSS JOIN (SELECT vec_id, embedding AS v FROM embeddings)) QUALIFY rank <= 6")
def knn(spark, d):
    v = _vectors(spark, d)
    return V.knn(v.where("id % 20 = 0").select(F.col("id").alias("question_id"), F.col("v").alias("q")), v, 6).select("question_id", "id", "rank")


@query("w2_retrieve", f"""WITH v AS (SELECT vec_id AS id, embedding AS v, CAST(label AS VARCHAR) AS entity, CAST(vec_id % 4 AS VARCHAR) AS category FROM embeddings),
q AS (SELECT vec_id AS question_id, embedding AS q, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS VARCHAR) WHEN vec_id % 3 = 1 THEN 'unknown' END AS we, CASE WHEN vec_id % 2 = 0 THEN [CAST(vec_id % 4 AS VARCHAR)] WHEN vec_id % 7 = 0 THEN ['none'] ELSE []::VARCHAR[] END AS wc, vec_id % 5 = 0 AS strict FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT question_id, id, entity, category, {_DIST} AS dist, strict, we, wc, (we IS NULL OR entity = we) AND (len(wc) = 0 OR list_contains(wc, category)) AS t1, we IS NOT NULL AND len(wc) > 0 AND entity = we AS t2, we IS NOT NULL OR len(wc) > 0 AS given FROM q CROSS JOIN v),
t AS (SELECT question_id, CASE WHEN bool_or(t1) THEN 1 WHEN bool_or(t2) THEN 2 WHEN NOT any_value(strict) AND any_value(given) THEN 3 ELSE 0 END AS tier FROM m GROUP BY 1)
SELECT m.question_id, id, tier, CAST(row_number() OVER (PARTITION BY m.question_id ORDER BY dist, id) AS INTEGER) AS rank FROM m JOIN t ON m.question_id = t.question_id WHERE (tier = 1 AND t1) OR (tier = 2 AND t2) OR tier = 3 QUALIFY rank <= 6""")
def retrieve(spark, d):
    k, v = F.col("id"), _vectors(spark, d)
    wanted = F.when(k % 3 == 0, F.col("entity")).when(k % 3 == 1, "unknown")
    cats = F.when(k % 2 == 0, F.array((k % 4).cast("string"))).when(k % 7 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    q = v.where("id % 20 = 0").select(k.alias("question_id"), F.col("v").alias("q"), wanted.alias("want_entity"), cats.alias("want_categories"), (k % 5 == 0).alias("strict"))
    return V.retrieve(q, v).select("question_id", "id", "tier", "rank")


_LEV = "CASE vec_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Bachelor' ELSE 'Master,PhD' END"
_CAND = "SELECT vec_id AS profile_id, label AS id, embedding AS q, CASE WHEN vec_id % 2 = 0 THEN 'Master' END AS level FROM embeddings WHERE vec_id % 20 = 0"
_TOPK = f"""a AS (SELECT profile_id, c.id, vec_id AS chunk_id, level, {_LEV} AS levels, {_DIST} AS dist FROM ({_CAND}) c JOIN (SELECT vec_id, label, embedding AS v FROM embeddings) e ON c.id = e.label),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY profile_id, id ORDER BY dist, chunk_id) <= 12),
k AS (SELECT profile_id, id, chunk_id, CAST(row_number() OVER (PARTITION BY profile_id, id ORDER BY dist, chunk_id) AS INTEGER) AS rank FROM b WHERE levels = '' OR level IS NULL OR list_contains(string_split(levels, ','), level) QUALIFY rank <= 4)"""


def _cands(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("profile_id"), F.col("label").cast("long").alias("id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") % 2 == 0, "Master").alias("level"))


def _levelled(spark, d):
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select(k.alias("chunk_id"), F.col("label").cast("long").alias("entity"), F.col("embedding").alias("v"), F.when(k % 3 == 0, "").when(k % 3 == 1, "Bachelor").otherwise("Master,PhD").alias("levels"))


@query("w3_topk_per_entity", f"WITH {_TOPK} SELECT profile_id, CAST(id AS BIGINT) AS id, rank, chunk_id FROM k")
def topk(spark, d):
    return V.topk_per_entity(_cands(spark, d), _levelled(spark, d)).select("profile_id", "id", "rank", "chunk_id")


@query("j3_attach_chunks", f"WITH {ENTITIES}, {_TOPK}, g AS (SELECT profile_id, id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids FROM k GROUP BY 1, 2) SELECT c.profile_id, CAST(c.id AS BIGINT) AS id, coalesce(chunk_ids, '') AS chunk_ids FROM ({_CAND}) c LEFT JOIN g ON c.profile_id = g.profile_id AND c.id = g.id JOIN entities e ON c.id = e.id")
def attach(spark, d):
    from ..adapters import entities

    return V.attach_chunks(_cands(spark, d), entities(spark, d), _levelled(spark, d)).select("profile_id", "id", "chunk_ids")


@query("f3_degree_filter", f"SELECT vec_id FROM embeddings WHERE {_LEV} = '' OR list_contains(string_split({_LEV}, ','), 'PhD')")
def degree(spark, d):
    return _levelled(spark, d).where(V.degree_filter(F.col("levels"), F.lit("PhD"))).select(F.col("chunk_id").alias("vec_id"))


@query("f4_metadata_where", "SELECT vec_id AS id FROM embeddings WHERE label = 3 AND vec_id % 4 IN (0, 2)")
def where(spark, d):
    return _vectors(spark, d).where(V.metadata_where("3", ["0", "2"])).select("id")


@query("p30_source_citations")
def citations(spark, d):
    pages = table(spark, d, "pages")
    hits = pages.select((F.col("page_id") % 40).alias("question_id"), F.col("page_id").alias("rank"), F.when(F.col("page_id") % 3 > 0, "Uni").otherwise("").alias("name"), F.when(F.col("page_id") % 4 > 0, F.concat_ws(" | ", "url", F.lit("manual://some-note"))).otherwise("").alias("source_pages"))
    return V.source_citations(hits)


@query("p30_source_label", r"WITH l AS (SELECT page_id, url, replace(replace(replace(split_part(split_part(regexp_replace(url, '/+$', ''), '/', -1), '?', 1), '%20', ' '), '-', ' '), '_', ' ') AS leaf FROM pages WHERE url LIKE 'http%') SELECT page_id, '- [Uni: ' || CASE WHEN len(leaf) > 48 THEN leaf[1:45] || '…' ELSE leaf END || '](' || url || ')' AS line FROM l")
def labels(spark, d):
    return table(spark, d, "pages").where("url LIKE 'http%'").select("page_id", V.source_label(F.col("url"), F.lit("Uni")).alias("line"))


