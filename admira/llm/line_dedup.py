"""Line dedup over windows of three consecutive lines.

Every window of ``window`` consecutive lines is hashed to 128 bits. A window whose hash occurs earlier, by (doc_id, text,
position), is a repeat, and every line that some repeat covers is removed; overlapping repeats merge because the covered
positions form a set. The first occurrence stays.

Only hashes move in the search: windows are counted with map-side combining, and the repeated hashes, stored, are joined
back by an equi-join whose hot keys Spark can split. Texts move once, to meet the positions they lose; the hint keeps this
plan for every size.

Defined results: a null text has no lines and stays null; a text of fewer lines than a window is never changed; an empty
line is a line; a text that loses every line becomes ''; rows with the same doc_id and text are one document and get the
same outcome; rows with one doc_id and other texts are documents of their own; an empty table gives an empty result; all
columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


def _windows(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """(a, b, id, th, pos): two 64-bit hashes of each window, the document, its text's hash and the position."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("l"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("l") - window),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("l", i + k) for k in range(window)]).alias("a"), F.xxhash64(F.lit(window), *[F.get("l", i + k) for k in range(window)]).alias("b")),
    )
    return lines.where(F.size("l") >= window).select("id", "th", F.explode(spans).alias("w")).select("w.a", "w.b", "id", "th", "w.pos")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """(id, th, starts): for each document with repeats, the positions at which repeated windows start."""
    spans = _windows(docs, doc_id, text, window)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "pos")
    repeated = stage(spans.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first"), "repeated")
    later = spans.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (place != F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))  # positions of one document


def _kept(lines: Column, starts: Column, window: int) -> Column:
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + window - 1))))
    gone = F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True)))
    return F.filter(lines, lambda _, i: ~F.coalesce(F.try_element_at(gone, i), F.lit(False)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; with ``counts``, n_lines and n_removed are added."""
    found = stage(covered(docs, doc_id, text, window).select(F.col("id").alias("__ld_id"), F.col("th").alias("__ld_th"), F.col("starts").alias("__ld_starts")), "covered")
    source = docs.withColumn("__ld_hash", F.xxhash64(text))
    out = source.join(found.hint("merge"), source[doc_id].eqNullSafe(F.col("__ld_id")) & (F.col("__ld_hash") == F.col("__ld_th")), "left")
    lines = F.split(source[text], "\n")
    kept = F.when(F.col("__ld_starts").isNull(), source[text]).otherwise(F.concat_ws("\n", _kept(lines, F.col("__ld_starts"), window)))
    out = out.withColumn("__ld_kept", kept)
    cols = [F.col("__ld_kept").alias(c) if c == text else source[c] for c in docs.columns]
    if counts:
        total = F.when(source[text].isNull(), 0).otherwise(F.size(lines))
        left = F.when(F.col("__ld_starts").isNull(), total).otherwise(F.size(_kept(lines, F.col("__ld_starts"), window)))
        cols += [total.cast("long").alias("n_lines"), (total - left).cast("long").alias("n_removed")]
    return out.select(*cols)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM l WHERE len(l) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM r WHERE k > 1),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l) p
         ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(CAST(len(l.l) AS BIGINT), 0) AS n_lines,
       CAST(coalesce(len(l.l), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
