"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source, word counts are summed by the hash's leading bits; the bucket in which the
budget ends is split by the next bits, and so on until it holds a single hash value. What the source contributes is then
a plain filter ``hash <= threshold``: no sort, and the thresholds of growing budgets are nested.

Defined results: a null or blank text has size 0 and takes part with 0 words; a null source is a source of its own, last
in order; repeated doc_ids share a hash and go in or out together; an empty table gives an empty result; other columns
are carried by ``mixed`` and ignored by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, bounded, running, stage

HASH_BITS = 60
LEVEL_BITS = 8


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: str):
    """The first 60 bits of the md5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple) -> DataFrame:
    """(src, source_size, target): weights repeat over the sources in code-point order, nulls last.

    Shares that would pass ``cap`` times the source's size stop there and the rest is shared again. The fixed point is
    found at once: in order of cap/weight, a source is capped while the level of those from it on reaches its own cap.
    """
    ranked = running(sizes, [F.col("src").asc_nulls_last()], {}).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__row") % len(weights) + 1).cast("int"))).drop("__row")
    ranked = ranked.withColumns({"c": F.col("source_size") * F.lit(float(cap)), "r": F.col("source_size") * F.lit(float(cap)) / F.col("w")})
    filled = running(ranked, [F.col("r"), F.col("src").asc_nulls_last()], {"c_before": "c", "w_before": "w"})
    total = F.broadcast(sizes.agg((F.sum("source_size") * F.lit(float(share))).alias("t")).crossJoin(ranked.agg(F.sum("w").alias("w_all"))))  # one row
    level = filled.join(total).withColumn("level", (F.col("t") - F.col("c_before")) / (F.col("w_all") - F.col("w_before"))).withColumn("capped", F.col("level") >= F.col("r"))
    free = F.broadcast(level.where(~F.col("capped")).agg(F.min_by("level", "__row").alias("free")))  # one row
    return level.join(free).select("src", "source_size", F.when(F.col("capped"), F.col("c")).otherwise(F.col("w") * F.col("free")).alias("target"))


def thresholds(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1)) -> tuple[DataFrame, int]:
    """(src, source_size, target, base, upto) for a stored table (src, size, h), and its number of rows.

    A document is taken ``base`` times, and once more where its hash is at most ``upto``.
    """
    sizes = stage(sized.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    n = sizes.count()
    plan = targets(sizes, share, cap, weights)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stage(plan.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    state = plan.select("src", F.lit(0).cast("long").alias("lo"), F.col("rest"), F.lit(None).cast("long").alias("upto"))
    for used in range(LEVEL_BITS, HASH_BITS + LEVEL_BITS, LEVEL_BITS):
        shift = max(0, HASH_BITS - used)
        width = 1 << (HASH_BITS - used + LEVEL_BITS)
        open_ = bounded(state.where("upto IS NULL").select(F.col("src").alias("o"), "lo", "rest"), n)
        inside = sized.join(open_, F.col("src").eqNullSafe(F.col("o")) & F.col("h").between(F.col("lo"), F.col("lo") + (width - 1)))
        bucket = (F.col("h") - F.col("lo")).bitwiseAND(-(1 << shift)) + F.col("lo")
        counts = inside.groupBy("src", bucket.alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("rest").alias("rest"), F.first("lo").alias("from"))
        upto_here = W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, 0)  # 256 buckets of a source at most
        summed = counts.withColumn("cum", F.sum("s").over(upto_here))
        edge = F.min(F.when(F.col("cum") > F.col("rest"), F.struct("b", "cum", "s", "h0", "h1")))
        found = summed.groupBy("src").agg(edge.alias("e"), F.min("from").alias("from"), F.min("rest").alias("rest"))
        left = F.col("rest") - (F.col("e.cum") - F.col("e.s"))
        single = F.col("e.h0") == F.col("e.h1")
        done = F.when(F.col("e").isNull(), F.lit((1 << HASH_BITS) - 1)).when(single, F.when(left * 2 >= F.col("e.s"), F.col("e.h0")).otherwise(F.col("e.h0") - 1))
        fresh = found.select("src", F.coalesce("e.b", "from").alias("lo"), F.coalesce(left, "rest").alias("rest"), done.cast("long").alias("upto"))
        state = stage(state.where("upto IS NOT NULL").unionByName(fresh), "level")
        if state.where("upto IS NULL").isEmpty():
            break
    last = state.select(F.col("src").alias("o"), "upto")
    return plan.join(bounded(last, n), F.col("src").eqNullSafe(F.col("o")), "left").select("src", "source_size", "target", "base", F.coalesce("upto", F.lit(-1)).alias("upto")), n


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return stage(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("src"), word_count(text).alias("size"), doc_hash(doc_id).alias("h")), "sized")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sized = _sized(docs, doc_id, text, source)
    marks, n = thresholds(sized, **how)
    marks = bounded(stage(marks.withColumnRenamed("src", "o"), "marks"), n)
    taken = F.col("size") * (F.col("base") + (F.col("h") <= F.col("upto")).cast("long"))
    return sized.join(marks, F.col("src").eqNullSafe(F.col("o"))).select(F.col("id").alias(doc_id), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, with their own columns only."""
    marks, n = thresholds(_sized(docs, doc_id, text, source), **how)
    marks = bounded(stage(marks.select(F.col("src").alias("__mix_src"), F.col("base").alias("__mix_base"), F.col("upto").alias("__mix_upto")), "marks"), n)
    copies = (F.col("__mix_base") + (doc_hash(doc_id) <= F.col("__mix_upto")).cast("long")).cast("int")
    out = docs.join(marks, docs[source].eqNullSafe(F.col("__mix_src"))).withColumn("__mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same mix in one sort: documents in hash order, taken while the middle of the next hash group fits the budget.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
sizes AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
filled AS (SELECT *, source_size * 2.0::DOUBLE AS c, source_size * 2.0::DOUBLE / w AS r FROM ranked),
level0 AS (SELECT *, row_number() OVER o AS k, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cb,
           coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS wb FROM filled WINDOW o AS (ORDER BY r, src NULLS LAST)),
level1 AS (SELECT *, ((SELECT sum(source_size) FROM sizes) * 1.5::DOUBLE - cb) / ((SELECT sum(w) FROM ranked) - wb) AS lv FROM level0),
plan AS (SELECT src, source_size, CASE WHEN lv >= r THEN c ELSE w * (SELECT min_by(lv, k) FROM level1 WHERE lv < r) END AS target FROM level1),
based AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM plan),
tied AS (SELECT src, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY src ORDER BY h) AS cum FROM sized GROUP BY src, h)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.base + CASE WHEN (b.target - b.base * b.source_size - (t.cum - t.s)) * 2 >= t.s AND b.target - b.base * b.source_size > 0 OR t.s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN based b ON d.src IS NOT DISTINCT FROM b.src JOIN tied t ON d.src IS NOT DISTINCT FROM t.src AND d.h = t.h
"""
