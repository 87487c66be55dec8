"""Filter interaction audit: what each filter removes in every order of the filters.

A document has a mask of the filters that it fails. Documents are counted by part and mask, which is all that the orders
need: an order removes a document at the first filter of its mask. Orders are numbered by their Lehmer rank, so those that
begin with the same letters lie in one interval of ranks. For each mask and each prefix of passed filters before a failed
one, the counts are added at the interval's start and taken back behind its end; one prefix sum across the ranks then gives
the removed documents of every order and step.

The five filters of ``masks``: A fewer than ``least_words`` words, B fewer than half of the words distinct, C more than 3 in
100 characters from A to Z, D any of ``#$%&*|``, E the text of a smaller id. Texts are looked at in Python, by batches and
in windows; what Spark moves afterwards is the id, the mask and a 128-bit hash of the text. Copies are found by the smallest
id of each hash: rows are first counted by (hash, part), so a text that a third of all rows hold is a few rows when it meets
its smallest id.

Defined results: a null text is empty; a null part is ''; rows with equal id and text are no copies of one another; a null id
is smaller than none and no copy, and has no label; a document is good or toxic where any of its label rows says so; every
order and step of a part has a row, zeros included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage

FILTERS = "ABCDE"
#: Bytes of a text whose words are Python objects at a time.
WINDOW = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_MARKS = [bytes([c]) for c in b"#$%&*|"]


def _windows(raw: bytes):
    """``raw`` in pieces that end at white space; a longer word is one piece."""
    at = 0
    while len(raw) - at > WINDOW:
        cut = at + WINDOW
        while cut < len(raw) and raw[cut] not in _SPACE:
            cut += 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def text_mask(raw: bytes, least_words: int = 200) -> int:
    """The bits of A to D that a text, as UTF-8, fails."""
    n, seen = 0, set()
    for piece in _windows(raw):
        words = piece.split()  # of bytes: at the white space of the contract
        n += len(words)
        seen.update(words)
    upper, points = len(raw) - len(raw.translate(None, _UPPER)), len(raw.translate(None, _CONTINUED))
    failed = (n < least_words, 100 * len(seen) < 50 * n, 100 * upper > 3 * points, any(m in raw for m in _MARKS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", least_words: int = 200) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and those of them with a label."""

    def run(batches):
        for batch in batches:
            raw, made, hashes = batch.column(2), [], []
            for a in range(0, len(batch), 256):  # some hundred texts are Python objects at a time
                texts = raw.slice(a, 256).to_pylist()
                made += [text_mask(t, least_words) for t in texts]
                hashes += [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int32()), pa.array(hashes, pa.binary())], names=["id", "part", "mask", "h"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    rows = rows.mapInArrow(run, f"id {kind}, part string, mask int, h binary")
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("h")).otherwise(F.lit(0).cast("long")))  # null ids meet nothing, anywhere

    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    known = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").alias("l")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    met = rows.join(known.withColumn("s", F.lit(0).cast("long")), (F.col("id") == F.col("l")) & (F.col("spread") == F.col("s")), "left")
    marked = met.select("id", "spread", "part", "mask", "h", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    each = marked.groupBy("id", "spread", "part", "mask", "h", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "good", "toxic")))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    texts = stage(each.groupBy("h", "part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"), first.alias("first"), nameless.alias("nameless")), "texts")
    least = texts.groupBy(F.col("h").alias("o")).agg(F.min("first.id").alias("least"))
    owner = F.coalesce(F.col("first.id") == F.col("least"), F.lit(False))
    kept = lambda value: F.when(owner, value).otherwise(F.lit(0))
    here = F.struct("mask", (F.col("nameless") + kept(F.col("first.n"))).alias("n"), kept(F.col("first.n") * F.col("first.good")).alias("good"), kept(F.col("first.n") * F.col("first.toxic")).alias("toxic"))
    split = texts.join(least, F.col("h") == F.col("o")).select("part", "n", "good", "toxic", here.alias("own"))
    copy = F.struct((F.col("own.mask") + F.lit(1 << 4)).alias("mask"), *[(F.col(c) - F.col(f"own.{c}")).alias(c) for c in ("n", "good", "toxic")])
    counted = split.select("part", F.explode(F.array("own", copy)).alias("x")).select("part", "x.*").where("n > 0")
    return counted.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def rank_of(prefix: tuple[int, ...], k: int) -> int:
    """The Lehmer rank of the first order of ``k`` filters that begins with ``prefix``."""
    return sum(sum(1 for j in range(p) if j not in prefix[:i]) * factorial(k - 1 - i) for i, p in enumerate(prefix))


def removal_intervals(k: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, from, to): the ranks of the orders in which a document with this mask is removed at this step."""
    out = []
    for mask in range(1, 1 << k):
        failed, passed = [j for j in range(k) if mask >> j & 1], [j for j in range(k) if not mask >> j & 1]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for j in failed:
                    at = rank_of((*before, j), k)
                    out.append((mask, step, at, at + factorial(k - step)))
    return out


def order_audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of counts (part, mask, n, good, toxic); bit j of a mask is the j-th letter of ``filters``.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    spark, k = counted.sparkSession, len(filters)
    counted = stage(counted, "masks")
    spans = F.broadcast(spark.createDataFrame(removal_intervals(k), "m int, step int, lo int, hi int"))  # fixed by k
    orders = F.broadcast(spark.createDataFrame([(r, "".join(p)) for r, p in enumerate(permutations(filters))], "rank int, filter_order string"))  # k! rows

    met = counted.join(spans, F.col("mask") == F.col("m"))
    end = lambda at, sign: F.struct(F.col(at).alias("rank"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
    ends = met.select("part", "step", F.explode(F.array(end("lo", 1), end("hi", -1))).alias("x")).select("part", "step", "x.*").where(F.col("rank") < factorial(k))
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) * k - 1))).alias("i"))
    zero = F.lit(0).cast("long")
    every = every.select("part", (F.col("i") % k + 1).cast("int").alias("step"), F.floor(F.col("i") / k).cast("int").alias("rank"), zero.alias("n"), zero.alias("good"), zero.alias("toxic"))
    jumps = ends.unionByName(every).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    across = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # k! rows
    sums = jumps.select("part", "step", "rank", *[F.sum(c).over(across).alias(c) for c in ("n", "good", "toxic")])

    letter = lambda name, holds: [F.sum(F.when(holds(j), F.col("n")).otherwise(0)).alias(f"{name}{j}") for j in range(k)]
    fails, alone = letter("f", lambda j: F.col("mask").bitwiseAND(1 << j) != 0), letter("u", lambda j: F.col("mask") == 1 << j)
    whole = counted.groupBy(F.col("part").alias("p")).agg(F.sum("n").alias("total"), *fails, *alone)
    joined = sums.join(orders, "rank").join(whole, F.col("part") == F.col("p")).withColumn("j", F.instr(F.lit(filters), F.substr("filter_order", "step", F.lit(1))))
    of = lambda name: F.element_at(F.array(*[F.col(f"{name}{j}") for j in range(k)]), F.col("j"))
    so_far = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # k rows
    whole_filter = W.partitionBy("part", "j")  # k! rows
    return joined.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).cast("long").alias("kept"), F.col("n").cast("long").alias("removed"), (of("f") - F.col("n")).cast("long").alias("redundant"),
        of("u").cast("long").alias("unique_fails"), F.col("good").cast("long").alias("good_lost"), F.col("toxic").cast("long").alias("toxic_lost"), F.sum("n").over(whole_filter).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return order_audit(masks(docs, labels, **how))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o AS filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, sum(n) AS total,
        sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS failing,
        sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS alone,
        sum(CASE WHEN translate(substr(filter_order, 1, step), fails, '') = substr(filter_order, 1, step) THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone THEN good ELSE 0 END) AS good, sum(CASE WHEN gone THEN toxic ELSE 0 END) AS toxic
      FROM (SELECT *, contains(fails, substr(filter_order, step, 1)) AND translate(substr(filter_order, 1, step - 1), fails, '') = substr(filter_order, 1, step - 1) AS gone FROM h, s) GROUP BY 1, 2, 3)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails,
  CAST(good AS BIGINT) AS good_lost, CAST(toxic AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
