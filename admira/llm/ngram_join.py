"""N-gram Jaccard join by a token-group matrix: documents whose shingle sets overlap enough, as classes.

1. A pass over the texts makes each document's set of ``k``-word shingles, as 64-bit hashes, and two 64-bit hashes of the
   set. The first names it; where sets of one name differ in the second, each is named by its second. Equal sets become
   one set. The pass also gives the shingles that repeat within a slice of documents; the commonest of these (``HOT`` at
   most, so that they may be broadcast) sort last in the order of shingles, all others by hash. Any order gives the same
   links; this one keeps shingles that many documents share out of the prefixes.
2. A second pass keeps of each set the first shingles in this order. Two sets whose Jaccard is at least the threshold
   share enough of them. If more than ``MET`` prefixes still meet in a shingle, it joins the common ones and the pass runs
   again. Only shingles that stand in two different sets stay, and only sets that share enough with others.
3. Similar sets form groups, cut into blocks of about ``BLOCK`` sets and ``ITEMS`` shingles at most: each set joins the leader it shares the most prefix
   shingles with. Sets linked to their leader are united at once.
4. Token-group matrix: (shingle, block) for the shingles of a block's members. A set's overlap with a block's union bounds
   its overlap with any member. Sets open only the blocks that reach the bound and hold other classes; an opened block is
   bounded again by the union of its whole sets before its members are compared exactly. Links unite classes.

Every link between different texts is found in step 4, or lies within a class already, so the classes are exact (up to
random collisions of the 64-bit hashes of shingles). No group is listed as pairs.

Defined results: null and wordless texts have an empty set, no links and themselves as class; a text of fewer than ``k``
words has its whole sequence as its only shingle; repeated rows are copies and each returned; documents with a null
doc_id keep a null class if nothing smaller is linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, stage
from .encode import text_slices
from .shingles import mix, shingle_sets

#: Common shingles that are broadcast: 1 MB.
HOT = 1 << 17
#: Shared prefix shingles asked for, as a share of the smaller set in per cent. Prefixes are longer by as much.
EXTRA = 5
#: Sets of a block, and sets that are compared with a block in one task; and their shingles together, 4 MB.
BLOCK, ITEMS = 256, 1 << 19
#: Prefixes that may meet in one shingle before it counts as common.
MET = 4096


def _sets(batch: pa.RecordBatch, k: int):
    """(first row, sets) for slices of a batch whose column 1 holds the texts."""
    texts = [(t or "") for t in batch.column(1).to_pylist()]
    for a, b in text_slices(texts):
        yield a, shingle_sets([t.encode("utf-8", "replace") for t in texts[a:b]], k)
    pa.default_memory_pool().release_unused()


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    return tuple(int(mix(s ^ np.uint64(c)).sum().view(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _name(s: np.ndarray, clashes: frozenset) -> int:
    first, second = _names(s)
    return second if first in clashes else first


def _summary(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: a document, with the names c and d and the size of its set. kind 1: shingle c is in n > 1 documents of a slice."""

    def run(batches):
        for batch in batches:
            for a, sets in _sets(batch, k):
                names = np.array([_names(s) for s in sets], dtype=np.int64)
                n = np.array([len(s) for s in sets], dtype=np.int32)
                common, count = np.unique(np.concatenate(sets), return_counts=True)
                common, count = common[count > 1].view(np.int64), count[count > 1].astype(np.int32)
                kind = np.repeat(np.array([0, 1], np.int8), [len(n), len(common)])
                none = pa.nulls(len(common), pa.int64())
                ids = [pa.concat_arrays([batch.column(c).slice(a, len(n)), none]) for c in (0, 2, 3)]
                c, d = np.concatenate([names[:, 0], common]), np.concatenate([names[:, 1], np.zeros(len(common), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), *ids, pa.array(np.concatenate([n, count])), pa.array(c), pa.array(d)], names=["kind", "id", "key", "th", "n", "c", "d"])

    return docs.mapInArrow(run, "kind byte, id long, key long, th long, n int, c long, d long")


def _need(n, percent: int):
    """The least overlap of a set of n shingles with a set it is linked to."""
    return -(-n * percent // 100)


def _prefixes(docs: DataFrame, k: int, percent: int, extra: int, hot, clashes: frozenset) -> DataFrame:
    def run(batches):
        common = hot.value
        for batch in batches:
            for _, sets in _sets(batch, k):
                tokens, names, sizes, counts = [], [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    n = len(s)
                    keep = min(n, n - _need(n, percent) + 1 + n * extra // 100)
                    if len(common):
                        at = np.searchsorted(common, s)
                        last = common[np.minimum(at, len(common) - 1)] == s
                        tokens.append(np.concatenate([s[~last], s[last]])[:keep])
                    else:
                        tokens.append(s[:keep])
                    names.append(_name(s, clashes))
                    sizes.append(n)
                    counts.append(keep)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(names, dtype=np.int64), counts)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts))], names=["token", "c", "n"])

    return docs.mapInArrow(run, "token long, c long, n int")


def _full_sets(docs: DataFrame, k: int, clashes: frozenset) -> DataFrame:
    """(c, items) of documents (id, text, c), where the text has that set."""

    def run(batches):
        for batch in batches:
            for a, sets in _sets(batch, k):
                names = batch.column(2).slice(a, len(sets)).to_pylist()
                kept = [(c, s.tobytes()) for c, s in zip(names, sets, strict=True) if len(s) and _name(s, clashes) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], names=["c", "items"])

    return docs.mapInArrow(run, "c long, items binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(c, comp): the smallest node that each node reaches. ``links`` holds pairs (a, b) of nodes.

    Each round takes the smallest label around and then follows labels (pointer jumping), so the number of rounds grows
    with the logarithm of a chain's length.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(nodes.select("c", F.col("c").alias("comp")), "labels")
    while not both.isEmpty():
        near = both.join(label.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("m"))
        low = label.join(near, "c", "left").select("c", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        low = stage(low, "labels")
        jump = low.select(F.col("c").alias("comp"), F.col("comp").alias("up"))
        new = stage(low.join(jump, "comp").select("c", F.col("up").alias("comp")), "labels")
        changed = not new.join(label.withColumnRenamed("comp", "old"), "c").where(F.col("comp") != F.col("old")).isEmpty()
        label = new
        if not changed:
            break
    return label


def _parts():
    """Into how many parts a group of sets (c, n) is cut."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / ITEMS)).cast("int")


def _open(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between queries (c, n, g, comp) and members (c, g, comp) of the blocks they open.

    A task leaves out links between what its other links unite already, so it gives fewer links than it holds sets.
    """
    parts = stage(queries.groupBy("g").agg(_parts().alias("parts")), "parts")
    asked = queries.join(parts, "g").select("c", "g", "comp", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("q")).join(sets, "c")
    opened = members.join(parts, "g").select("c", "g", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).join(sets, "c")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        if len(left) and len(right):
            group = [np.frombuffer(x, dtype=np.uint64) for x in right["items_m"].to_pylist()]
            names, comp = right["c_m"].to_pylist(), right["comp_m"].to_pylist()
            size = np.array([len(x) for x in group])
            every, starts = np.concatenate(group), np.concatenate([[0], np.cumsum(size)[:-1]])
            union = np.unique(every)
            for c, own, data in zip(left["c_q"].to_pylist(), left["comp_q"].to_pylist(), left["items_q"].to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=np.uint64)
                at = np.searchsorted(x, union)
                if np.count_nonzero(x[np.minimum(at, len(x) - 1)] == union) < _need(len(x), percent):
                    continue  # no member can reach the overlap
                at = np.searchsorted(x, every)
                both = np.add.reduceat((x[np.minimum(at, len(x) - 1)] == every).astype(np.int64), starts)
                hits = np.flatnonzero(100 * both >= percent * (len(x) + size - both)).tolist()
                for h in hits:
                    a, b = find(own), find(comp[h])
                    if a != b:
                        root[a] = b
                        out.append((c, names[h]))
        a, b = zip(*out, strict=True) if out else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    left = asked.select(*[F.col(x).alias(f"{x}_q") for x in ("c", "g", "q", "comp", "items")]).groupBy("g_q", "q_q")
    right = opened.select(*[F.col(x).alias(f"{x}_m") for x in ("c", "g", "q", "comp", "items")]).groupBy("g_m", "q_m")
    return left.cogroup(right).applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, k: int = 5, percent: int = 80, extra: int = EXTRA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, th (its text's hash), n (size of its set), component_id."""
    th = F.xxhash64(F.col(text).cast("string"))
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), th).alias("key"), th.alias("th"))
    seen = stage(_summary(base, k), "summary")
    alike = seen.where("kind = 0").groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo != hi").select("c")
    clashes = frozenset(r.c for r in alike.collect())  # different sets of one 64-bit name: none below billions of sets
    docs_of = seen.where("kind = 0").withColumn("c", F.when(F.col("c").isin(list(clashes)), F.col("d")).otherwise(F.col("c")) if clashes else F.col("c")).drop("kind", "d")

    common = stage(seen.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).where("n > 4").orderBy(F.desc("n"), "c").limit(HOT), "common")
    rows, several = _met(base, k, percent, extra, common, clashes)
    met = several.where(F.col("count") > MET)
    if not met.isEmpty():
        more = met.select(F.col("token").alias("c"), F.col("count").alias("n"))
        common = common.unionByName(more).groupBy("c").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "c").limit(HOT)
        rows, several = _met(base, k, percent, extra, common, clashes)
    shared = stage(rows.join(several.select("token"), "token"), "repeated")
    shared = stage(shared.groupBy("token", "c").agg(F.first("n").alias("n")), "shared")
    enough = F.col("k") > F.floor(F.floor(F.col("n") * percent / 100) * extra / 100)
    able = stage(shared.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(enough).select("c"), "able")
    shared = _repeated(stage(shared.join(bounded(able, able.count()), "c").select("token", "c", "n"), "able-rows"))
    nodes = stage(shared.groupBy("c").agg(F.first("n").alias("n")), "nodes")
    sets = _load_sets(base, docs_of, nodes, k, clashes)

    fits = (F.col("n") * percent <= F.col("l.n") * 100) & (F.col("l.n") * percent <= F.col("n") * 100)
    lead = stage(shared.groupBy("token").agg(F.min(F.struct(F.xxhash64("c").alias("h"), "c", "n")).alias("l")), "leaders")
    near = shared.join(lead, "token").where((F.col("c") != F.col("l.c")) & fits)
    agree = near.groupBy("c", F.col("l.c").alias("g")).agg(F.count(F.lit(1)).alias("k"), F.first(F.least("n", "l.n")).alias("least"))
    picked = stage(agree.where(F.col("k") * 200 > F.col("least") * extra).groupBy("c").agg(F.max(F.struct("k", "g")).alias("b")).select("c", "b.g"), "picked")
    leaders = picked.select("g").distinct().select(F.col("g").alias("c"), "g", F.col("g").alias("comp"))
    links = stage(_open(picked.join(nodes, "c").withColumn("comp", F.col("c")), leaders, sets, percent), "links")
    comp = components(nodes, links)

    grouped = nodes.join(picked, "c", "left").select("c", "n", F.coalesce("g", "c").alias("leader"))
    blocks = stage(grouped.groupBy("leader").agg(_parts().alias("m")), "blocks")
    block = F.xxhash64("leader", F.pmod(F.xxhash64("c", F.lit(1)), "m"))
    placed = stage(grouped.join(blocks, "leader").select("c", block.alias("g")).join(comp, "c"), "placed")
    likely = stage(_candidates(shared, placed, percent, extra), "likely")
    members = placed.join(likely.select("g").distinct(), "g", "left_semi").select("c", "g", "comp")
    found = stage(_open(likely, members, sets, percent), "links")
    comp = components(nodes, links.unionByName(found))

    first = stage(docs_of.where("n > 0").groupBy("c").agg(F.min("id").alias("first")), "first")
    placed = stage(first.join(comp, "c", "left").select("c", "first", F.coalesce("comp", "c").alias("comp")), "placed")
    lowest = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = stage(placed.join(lowest, "comp").select("c", "component_id"), "named")
    out = docs_of.where("n > 0").join(named, "c").select("id", "th", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out.unionByName(docs_of.where("n = 0").select("id", "th", "n", F.col("id").alias("component_id")))


def _met(base: DataFrame, k: int, percent: int, extra: int, common: DataFrame, clashes: frozenset) -> tuple[DataFrame, DataFrame]:
    """The prefixes with the shingles of ``common`` last, and (token, count) of tokens that stand in more than one."""
    hot = base.sparkSession.sparkContext.broadcast(np.sort(common.select("c").toArrow()["c"].to_numpy().view(np.uint64)))
    rows = stage(_prefixes(base, k, percent, extra, hot, clashes), "prefixes")
    return rows, stage(rows.groupBy("token").count().where("count > 1"), "tokens")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose token stands in more than one row, stored."""
    several = stage(rows.groupBy("token").count().where("count > 1").select("token"), "tokens")
    return stage(rows.join(several, "token"), "repeated")


def _candidates(shared: DataFrame, placed: DataFrame, percent: int, extra: int) -> DataFrame:
    """(c, g): sets and blocks that may hold a linked set of another class, by the token-group matrix of shared shingles."""
    rows = stage(shared.join(placed, "c"), "rows")
    matrix = rows.groupBy("token", F.col("g").alias("b")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    matrix = stage(matrix, "matrix")
    fits = ((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))) & (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100)
    met = rows.join(matrix, "token").where(fits).groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("comp").alias("comp"), F.min("least").alias("least"))
    return met.where(F.col("k") > F.floor(F.least("n", "least") * extra / 100)).select("c", "n", F.col("b").alias("g"), "comp")


def _load_sets(base: DataFrame, docs_of: DataFrame, wanted: DataFrame, k: int, clashes: frozenset) -> DataFrame:
    """(c, items) of the wanted sets, from the text of one document of each."""
    one = stage(docs_of.join(wanted, "c", "left_semi").groupBy("c").agg(F.min("key").alias("one")), "one")
    texts = base.join(bounded(one, one.count()), F.col("key") == F.col("one")).select("id", "text", "c").dropDuplicates(["c", "text"])
    return stage(_full_sets(texts, k, clashes), "sets")


def join(docs: DataFrame, k: int = 5, percent: int = 80, extra: int = EXTRA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return classes(docs, k, percent, extra, doc_id, text).select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, extra: int = EXTRA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents linked to one of smaller doc_id, and with one row of those equal in doc_id and text.

    Rows with a null doc_id, and texts without words, stay. Of equal rows the first in the order of all columns' text stays.
    """
    found = stage(classes(docs, k, percent, extra, doc_id, text).where("n > 0 AND id IS NOT NULL"), "classes")
    keys = (F.col("id").alias("__nj_id"), F.col("th").alias("__nj_th"))
    gone = stage(found.where("component_id < id").select(*keys).distinct(), "dropped")
    mine = [docs[doc_id].cast("long") == F.col("__nj_id"), F.xxhash64(docs[text].cast("string")) == F.col("__nj_th")]
    kept = docs.join(bounded(gone, gone.count()), mine, "left_anti")
    twins = stage(found.groupBy("id", "th").count().where("count > 1").select(*keys), "twins")
    n = twins.count()
    if not n:
        return kept
    mine = [kept[doc_id].cast("long") == F.col("__nj_id"), F.xxhash64(kept[text].cast("string")) == F.col("__nj_th")]
    order = W.partitionBy("__nj_i", "__nj_t").orderBy("__nj_all")  # rows equal in doc_id and text
    alike = kept.join(bounded(twins, n), mine, "left_semi")
    alike = alike.withColumns({"__nj_i": F.col(doc_id), "__nj_t": F.xxhash64(F.col(text).cast("string")), "__nj_all": F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))})
    one = alike.withColumn("__nj_k", F.row_number().over(order)).where("__nj_k = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(bounded(twins, n), mine, "left_anti").unionByName(one)
