"""Stupid-backoff language-model scores, computed relationally.

    S(w | u v) = c(u v w) / c(u v)      where the corpus has u v w
    S(w | v)   = c(v w) / c(v)          else, where it has v w
    S(w)       = c(w) / N               elsewhere

times ``backoff`` for every level below ``order``. Counts are those of the whole corpus and no n-gram is pruned, so an
n-gram of a document is always found: by plain counts no word backs off, and the score compares a text with the rest of
the corpus by the counts' sizes. With ``by_others`` an n-gram counts only where another document has it too, so a document's
own n-grams don't vouch for it and its words back off. A mark precedes a document's first word and no n-gram reaches beyond
it. A document's score is the sum of the logarithms over its words.

By plain counts a document's score is the sum of the logarithms of its longest n-grams' counts, less those of the n-grams
(or words) that they continue. With ``by_others`` an n-gram that counts has a suffix that counts, so a score is the sum of
what its words would get by themselves, what each of its bigrams that counts adds, and what each of its trigrams does. Either
way each part is a plain look-up.

1. Words are counted with combining on the map side. The commonest (``TOP_WORDS`` at most) get numbers and go to every
   task with their counts. Other words that occur again go to every task as a Bloom filter of fixed size: an n-gram with
   a word that occurs once is in one document only and is not moved; a false answer of the filter costs a row.
2. Documents are exploded to their distinct n-grams, dealt by hash. By plain counts each n-gram's rows are added up where
   they meet, in one sorted pass, and each row takes its logarithm along. With ``by_others`` the count table of each order is
   grouped from them in the same partitions, gets what its n-grams add by joins with the tables of words and of shorter
   n-grams, and is joined to the exploded n-grams. The sums meet by document.
3. N-grams that are frequent within slices of the corpus (``HOT_GRAMS`` of an order at most) are counted exactly and sent
   to every task, where they are added up at once: no frequent key gathers rows in one place. Any other has a share of
   under one in ``HOT_GRAMS``, or stands less than ``HOT_IN_SLICE`` times in each slice.

Words are runs without white space, A-Z lower-cased, and known by 64-bit hashes.

Defined results: null and wordless texts have 0 words and a null score; repeated rows are documents of their own and
counted and scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage
from .encode import text_slices
from .shingles import mix, words

BACKOFF = 0.4
ORDER = 2
#: Words and n-grams of an order whose counts are broadcast: 16 MB and 2 MB at most. An n-gram must occur so often in a slice.
TOP_WORDS, HOT_GRAMS, HOT_IN_SLICE = 1 << 20, 1 << 16, 4
#: Bits of the filter of words that occur again: 8 MB.
FILTER_BITS = 1 << 26
#: Exploded n-grams of a partition, about, and characters of a slice.
ROWS, SLICE = 1 << 21, 1 << 20
_START = np.uint64(0x243F6A8885A308D3)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_RARE = np.uint64(1 << 63)
_TRI = 1 << 61


def _slices(batch: pa.RecordBatch):
    """(first row, number of rows, document, place, v, w) of slices of a batch whose column 2 holds the texts."""
    texts = [t or "" for t in batch.column(2).to_pylist()]
    for a, b in text_slices(texts, SLICE):
        w, counts = words([t.encode("utf-8", "replace") for t in texts[a:b]])
        of = np.repeat(np.arange(b - a), counts)
        place = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
        v = np.concatenate([[_START], w[:-1]]) if len(w) else w
        v[place == 0] = _START
        yield a, b - a, of, place, v, w


def _hashed(v: np.ndarray, w: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of ``k`` words that end at each place, and the places that have one."""
    two = mix(v * _MULT + w)
    if k == 2:
        return two, np.arange(len(w))
    at = np.flatnonzero(place > 0)
    return mix(two[at - 1] * _MULT + w[at] + np.uint64(k)), at


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys``, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _survey(docs: DataFrame, order: int) -> DataFrame:
    """kind 0: word h occurs n times; 1: n documents have words; k: the n-gram h of k words is frequent in a slice."""

    def run(batches):
        for batch in batches:
            for _, _, of, place, v, w in _slices(batch):
                parts = [(0, *np.unique(w, return_counts=True)), (1, np.zeros(1, np.uint64), np.array([np.count_nonzero(place == 0)]))]
                for k in range(2, order + 1):
                    h, n = np.unique(_hashed(v, w, place, k)[0], return_counts=True)
                    parts.append((k, h[n >= HOT_IN_SLICE], n[n >= HOT_IN_SLICE]))
                kind = np.repeat(np.array([p[0] for p in parts], np.int8), [len(p[1]) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([p[1] for p in parts]).view(np.int64)), pa.array(np.concatenate([p[2] for p in parts]).astype(np.int64))], names=["kind", "h", "n"])

    return docs.mapInArrow(run, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, sorted, and counts of the rows above the least count that leaves at most ``most`` of them."""
    by_count = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("c")).count().orderBy(F.desc("c")).collect()  # 65536 rows at most
    held, least = 0, (1 << 16) + 1
    for r in by_count:
        held += r["count"]
        if held > most:
            break
        least = r.c
    got = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    keys, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = keys.argsort()
    return keys[order], n[order]


def _again(singles: DataFrame) -> np.ndarray:
    """The filter of words that occur twice at least, in words of 64 bits."""
    place = F.col("h").bitwiseAND(FILTER_BITS - 1)
    bits = singles.where("n > 1").groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("b")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    out[bits["i"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)
    return out


class _Names:
    """Ids of words and n-grams: numbers for the commonest words, of which n-grams are put together; else hashes."""

    def __init__(self, keys: np.ndarray, again: np.ndarray | None = None):
        self.keys, self.again = keys, again
        self.start = np.uint64(np.searchsorted(keys, _START))

    def word(self, h: np.ndarray) -> np.ndarray:
        at = _find(self.keys, h)
        return np.where(at >= 0, at.astype(np.uint64), h | _RARE)

    def before(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The ids of the words before each."""
        return np.where(place == 0, self.start, np.roll(ids, 1))

    def once(self, ids: np.ndarray) -> np.ndarray:
        """Which words occur once in the corpus, for certain."""
        rare = np.flatnonzero(ids >= _RARE)
        place = ids[rare] & np.uint64(FILTER_BITS - 1)
        out = np.zeros(len(ids), dtype=bool)
        out[rare] = self.again[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 0
        return out

    @staticmethod
    def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where((v | w) < _RARE, v << np.uint64(20) | w, mix(v * _MULT + w) | _RARE)

    @staticmethod
    def triple(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.where((u | v | w) < _RARE, np.uint64(_TRI) | u << np.uint64(40) | v << np.uint64(20) | w, mix(mix(u * _MULT + v) * _MULT + w) | _RARE)


def _exact(docs: DataFrame, shared) -> DataFrame:
    """(k, i, n, d, g): the frequent n-gram i of k words occurs n times in d documents; g is the id of a pair."""

    def run(batches):
        keys, hot = shared.value
        names = _Names(keys)
        for batch in batches:
            for _, size, of, place, v, w in _slices(batch):
                for k, frequent in hot.items():
                    h, at = _hashed(v, w, place, k)
                    i = _find(frequent, h)
                    mine = np.flatnonzero(i >= 0)
                    seen, where, n = np.unique(i[mine], return_index=True, return_counts=True)
                    d = np.bincount(np.unique(i[mine] * size + of[at[mine]]) // size, minlength=len(frequent))[seen]
                    one = at[mine[where]]
                    g = names.pair(names.word(v[one]), names.word(w[one]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen), pa.array(n), pa.array(d), pa.array(g.view(np.int64))], names=["k", "i", "n", "d", "g"])

    return docs.mapInArrow(run, "k int, i long, n long, d long, g long").groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.first("g").alias("g"))


def _table(spark: SparkSession, keys: np.ndarray, values: np.ndarray, names: tuple[str, str]) -> DataFrame:
    frame = pd.DataFrame({names[0]: keys.astype(np.int64), names[1]: values.astype(np.int64)})
    return spark.createDataFrame(frame, f"{names[0]} long, {names[1]} long")


def _mark(t):
    return F.shiftrightunsigned(t, 32)


def _plain(base: DataFrame, shared, order: int, partitions: int, backoff: float) -> tuple[DataFrame, DataFrame]:
    """By plain counts every n-gram is found, so a score is a sum of logarithms of counts: of each longest n-gram, less that
    of what it continues; no count is asked for by two keys, and no n-gram's parts are moved. (a, t, id, n, x): documents and what is known of their scores at once; (a, m, x): the rest.
    """

    def asked(table, v, w, place):
        """What each place gets at once, and the other counts that it asks for: (g, places, what is taken off less, longest)."""
        keys, counts, hot, hot_n, _, again = table
        names = _Names(keys, again)
        ww = names.word(w)
        wv = names.before(ww, place)
        once = names.once(ww)
        lone = once | np.roll(once, 1) & (place > 0)  # an n-gram with a word that occurs once occurs once
        first, last = place == 0, np.append(place[1:] == 0, True)[: len(w)]
        begin = (order - 2) * np.log(backoff) - np.log(counts[names.start])  # a text's first word has no trigram
        value, rest = np.where(first, begin, 0.0), []
        if order == 2:
            known = np.flatnonzero(ww < _RARE)
            value[known] -= ~last[known] * np.log(counts[ww[known]])
            at = np.flatnonzero((ww >= _RARE) & ~once)
            rest.append((ww[at], at, last[at].astype(np.int64), False))
        for k in range(2, order + 1):
            h, at = _hashed(v, w, place, k)
            i = _find(hot[k], h)
            here = i >= 0
            times = 1 if k == order else first[at].astype(np.int64) + last[at] - 1
            value[at] += times * np.where(here, np.log(np.maximum(hot_n[k], 1))[i], 0.0) if len(hot[k]) else 0.0
            moved = ~(here | lone[at] | (lone[at - 1] if k == 3 else False))
            at = at[moved]
            g = names.pair(wv[at], ww[at]) if k == 2 else names.triple(wv[at - 1], wv[at], ww[at])
            rest.append((g, at, np.zeros(len(at), np.int64) if k == order else first[at].astype(np.int64) + last[at], k == order))
        return value, rest

    def explode(batches):
        """A document's distinct n-grams: g, a and, in t, how often, and 3 for the longest or what is taken off less."""
        for batch in batches:
            a_, t_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, _, of, place, v, w in _slices(batch):
                _, rest = asked(shared.value, v, w, place)
                g, at, less = (np.concatenate([r[j] for r in rest]) for j in range(3))
                longest = np.repeat([r[3] for r in rest], [len(r[0]) for r in rest])
                doc = of[at]
                rank = np.lexsort((g, doc))
                g, doc = g[rank], doc[rank]
                new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])) if len(g) else np.empty(0, np.int64)
                n = np.diff(np.append(new, len(g)))
                kind = np.where(longest[rank[new]], 3, np.add.reduceat(less[rank], new) if len(new) else 0)
                doc = doc[new] + start
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(a_[doc]), pa.array(t_[doc] | n << 2 | kind)], names=["g", "a", "t"])
            pa.default_memory_pool().release_unused()

    def own(batches):
        """A document, its words and what is known at once."""
        for batch in batches:
            a_, t_ = batch.column(0), batch.column(1)
            for start, size, of, place, v, w in _slices(batch):
                x = np.bincount(of, asked(shared.value, v, w, place)[0], minlength=size).astype(float)  # whole numbers where there is no word
                n = np.bincount(of, minlength=size)
                yield pa.RecordBatch.from_arrays([*[c.slice(start, size) for c in (a_, t_, batch.column(3))], pa.array(n), pa.array(x)], names=["a", "t", "id", "n", "x"])
            pa.default_memory_pool().release_unused()

    told = base.mapInArrow(own, "a long, t long, id long, n long, x double")
    rows = base.mapInArrow(explode, "g long, a long, t long").repartition(partitions, "g")
    n, kind = F.shiftright(F.col("t").bitwiseAND(0xFFFFFFFF), 2), F.col("t").bitwiseAND(3)
    counted = rows.withColumn("n", F.sum(n).over(W.partitionBy("g")))  # no g has many rows: the frequent ones are not moved
    times = F.when(kind == 3, n).otherwise(kind - n)
    return told, counted.groupBy("a", _mark(F.col("t")).alias("m")).agg(F.sum(times * F.log("n")).alias("x"))


def _by_others(base: DataFrame, shared, order: int, partitions: int, backoff: float, total: int, seen: DataFrame, hot_pairs: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """As ``_plain``, where an n-gram counts only if two documents have it."""
    spark, (keys, counts, *_) = base.sparkSession, shared.value
    orders = range(2, order + 1)
    alone = float(np.log(backoff) * (order - 1) - np.log(max(total, 1)))  # and the logarithm of c(w)
    step = float(np.log(backoff))

    def priced(table, ww, wv, v, w, place, k):
        """(ids, places, what each n-gram adds, which are priced here, which are in one document) for n-grams of ``k`` words."""
        _, counts, hot, n, d, _ = table
        names = _Names(table[0], table[5])
        h, at = _hashed(v, w, place, k)
        i = _find(hot[k], h)
        once = names.once(ww)
        once_v = np.roll(once, 1) & (place > 0)
        alone_ = once | once_v
        if k == 2:
            g = names.pair(wv, ww)
            here = (i >= 0) & ((wv | ww) < _RARE)
            i, a, b = i[here], wv[here], ww[here]
            adds = np.log(np.maximum(n[2][i], 1)) - np.log(counts[a]) - (alone - step * (order - 2)) - np.log(counts[b])
            shared_by = d[2][i] > 1
        else:
            g = names.triple(wv[at - 1], wv[at], ww[at])
            two = _find(hot[2], _hashed(v, w, place, 2)[0])
            here = (i >= 0) & (two[at - 1] >= 0) & (two[at] >= 0) & ((wv[at - 1] | wv[at] | ww[at]) < _RARE)
            i, p, s = i[here], two[at - 1][here], two[at][here]
            adds = np.log(np.maximum(n[3][i], 1)) - np.log(np.maximum(n[2][p], 1)) - step - np.log(np.maximum(n[2][s], 1)) + np.log(counts[wv[at][here]])
            shared_by = d[3][i] > 1
            alone_ = alone_[at] | alone_[at - 1]
        return g, at, np.where(shared_by, adds, 0.0), here, alone_

    def exploded(k: int) -> DataFrame:
        """The distinct n-grams of every document, but for those that are priced at once: g, a and, in t, how often.

        ``parts`` are the parts that can't be read from g, as it holds a rare word: the words of a bigram; the shorter
        n-grams and the middle word of a trigram. Beside the bigrams go the rare words themselves, without parts.
        """
        parts = ("v", "w") if k == 2 else ("p", "s", "v")

        def run(batches):
            names = _Names(shared.value[0], shared.value[5])
            for batch in batches:
                a_, t_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for first, _, of, place, v, w in _slices(batch):
                    ww = names.word(w)
                    wv = names.before(ww, place)
                    g, at, _, here, lone = priced(shared.value, ww, wv, v, w, place, k)
                    moved = ~(here | lone)
                    g, at = g[moved], at[moved]
                    # rare words wait for their counts, but for those that occur once: the logarithm of 1 adds nothing
                    waits = np.flatnonzero((ww >= _RARE) & ~names.once(ww)) if k == 2 else at[:0]
                    word = np.repeat([False, True], [len(g), len(waits)])
                    g, at = np.concatenate([g, ww[waits]]), np.concatenate([at, waits])
                    rank = np.lexsort((g, of[at]))
                    g, at, word = g[rank], at[rank], word[rank]
                    doc = of[at]
                    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])) if len(g) else np.empty(0, np.int64)
                    n = np.diff(np.append(new, len(g)))
                    g, i, plain = g[new], at[new], word[new] | (g[new] < _RARE)
                    doc = of[i] + first
                    told = (wv[i], ww[i]) if k == 2 else (names.pair(wv[i - 1], wv[i]), names.pair(wv[i], ww[i]), wv[i])
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(a_[doc]), pa.array(t_[doc] | n), *[pa.array(x.view(np.int64), mask=plain) for x in told]], names=["g", "a", "t", *parts])
                pa.default_memory_pool().release_unused()

        made = base.mapInArrow(run, ", ".join(f"{c} long" for c in ("g", "a", "t", *parts)))
        return made.where("g IS NOT NULL").repartition(partitions, "g")

    def rest(batches):
        """A document, its words and what is priced at once."""
        names = _Names(shared.value[0], shared.value[5])
        for batch in batches:
            a_, t_ = batch.column(0), batch.column(1)
            for first, size, of, place, v, w in _slices(batch):
                ww = names.word(w)
                wv, known = names.before(ww, place), ww < _RARE
                value = np.full(len(w), alone)
                value[known] += np.log(shared.value[1][ww[known]])
                x = np.bincount(of, value, minlength=size).astype(float)  # whole numbers where there is no word
                for k in orders:
                    _, at, adds, here, _ = priced(shared.value, ww, wv, v, w, place, k)
                    x += np.bincount(of[at[here]], adds, minlength=size)
                n = np.bincount(of, minlength=size)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, size) for c in (a_, t_, batch.column(3))], pa.array(n), pa.array(x)], names=["a", "t", "id", "n", "x"])
            pa.default_memory_pool().release_unused()

    told = base.mapInArrow(rest, "a long, t long, id long, n long, x double")
    times = F.col("t").bitwiseAND(0xFFFFFFFF)
    low = lambda c: c.bitwiseAND((1 << 20) - 1)
    g = F.col("g")
    number = F.broadcast(_table(spark, np.arange(len(keys)), counts, ("id_", "c")))  # TOP_WORDS rows at most
    least = int(counts[keys != _START].min(initial=1 << 62))  # rarer words have no number
    rare_words = seen.where((F.col("kind") == 0) & (F.col("n") > 1) & (F.col("n") < least)).select(F.col("h").bitwiseOR(F.lit(-(1 << 63))).alias("id_"), F.col("n").alias("c"))

    def counted(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        """The count table: n-grams, with their parts where words are rare, and rare words. In the rows' own partitions."""
        table = rows.groupBy("g").agg(F.sum(times).alias("n"), F.count("a").alias("d"), *[F.max(c).alias(c) for c in parts])
        return table.where((F.col("d") > 1) | reduce(and_, [g < 0, *[F.isnull(c) for c in parts]])).drop("d")

    def looked_up(df: DataFrame, c: str, place, rare: bool) -> DataFrame:
        """Add the count of the word ``place``: a number, or where ``rare`` says so maybe a rare word."""
        known = number.select(F.col("id_").alias("__id"), F.col("c").alias(f"c_{c}"))
        df = df.join(known, place == F.col("__id"), "left").drop("__id")
        if not rare:
            return df
        few = rare_words.select(F.col("id_").alias("__id"), F.col("c").alias("__c"))
        return df.join(few, place == F.col("__id"), "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", "__c", F.lit(1))).drop("__id", "__c")  # a word that is nowhere occurs once

    def adding(rows: DataFrame, model: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        """What the n-grams of a document add. Every column of ``rows`` is named here and in ``counted``, so that both read one exchange."""
        empty = [F.isnull(c) for c in parts]  # parts are given together or not at all
        x = F.when(reduce(and_, [e == empty[0] for e in empty[1:]]), F.col("x"))
        return rows.join(model.hint("merge"), "g").groupBy("a", _mark(F.col("t")).alias("m")).agg(F.sum(times * x).alias("x"))

    rows = exploded(2)
    table = counted(rows, ("v", "w"))
    adds = F.log("n") - F.log("c_v") - F.lit(alone - step * (order - 2)) - F.log("c_w")
    rare = looked_up(looked_up(table.where("v IS NOT NULL"), "v", F.col("v"), True), "w", F.col("w"), True).select("g", adds.alias("rare"))
    model = looked_up(looked_up(table, "v", F.when(g >= 0, F.shiftright("g", 20)), False), "w", F.when(g >= 0, low(g)), False).join(rare, "g", "left")
    found = adding(rows, model.select("g", F.when(g >= 0, adds).when(F.isnull("v"), F.log("n")).otherwise(F.col("rare")).alias("x")), ("v", "w"))
    if order == 3:
        frequent = hot_pairs[0] >= 0  # the others hold a rare word and are in the count table
        pairs = stage(table.where((g >= 0) | F.isnotnull("v")).select("g", "n").unionByName(_table(spark, hot_pairs[0][frequent], hot_pairs[1][frequent], ("g", "n"))), "pairs")
        rows = exploded(3)
        table = counted(rows, ("p", "s", "v")).withColumns({"p": F.coalesce("p", F.shiftright(g - F.lit(_TRI), 20)), "s": F.coalesce("s", g.bitwiseAND((1 << 40) - 1)), "v": F.coalesce("v", low(F.shiftright("g", 20)))})
        both = table.join(pairs.select(F.col("g").alias("p"), F.col("n").alias("n_p")), "p").join(pairs.select(F.col("g").alias("s"), F.col("n").alias("n_s")), "s")
        adds = F.log("n") - F.log("n_p") - F.lit(step) - F.log("n_s") + F.log("c_v")
        found = found.unionByName(adding(rows, looked_up(both, "v", F.col("v"), True).select("g", adds.alias("x")), ("p", "s", "v")))
    return told, found


def score(docs: DataFrame, backoff: float = BACKOFF, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", by_others: bool = False) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithms, summed), mean_log_score.

    ``order`` is 2 or 3; 3 moves twice as many rows. ``by_others``: only n-grams that two documents have count.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    th = F.xxhash64(F.col(text).cast("string"))
    key = F.coalesce(F.col(doc_id).cast("long"), th).alias("a")
    # ids that stand for several texts: rows carry a mark of the text as well
    several = docs.select(key, th.alias("t")).groupBy("a").agg((F.min("t") != F.max("t")).alias("s")).agg(F.max("s").alias("s")).first()["s"]
    base = docs.select(key, (F.shiftleft(th, 32) if several else F.lit(0).cast("long")).alias("t"), F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id"))
    seen = stage(_survey(base, order), "survey")
    singles = seen.where("kind = 0").select("h", "n")
    total, starts = (seen.agg(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias("n")).first()["n"] or 0 for k in (0, 1))
    keys, counts = _most(singles, TOP_WORDS - 2)
    at = int(np.searchsorted(keys, _START))
    keys, counts = np.insert(keys, at, _START), np.insert(counts, at, max(starts, 1))
    orders = range(2, order + 1)
    hot = {k: _most(seen.where(F.col("kind") == k), HOT_GRAMS)[0] for k in orders}
    hot_n, hot_d, hot_g = ({k: np.zeros(len(hot[k]), np.int64) for k in orders} for _ in range(3))
    for r in _exact(base, context.broadcast((keys, hot))).collect():  # HOT_GRAMS rows an order at most
        hot_n[r.k][r.i], hot_d[r.k][r.i], hot_g[r.k][r.i] = r.n, r.d, r.g
    shared = context.broadcast((keys, counts, hot, hot_n, hot_d, _again(singles)))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // ROWS))
    told, found = _by_others(base, shared, order, partitions, backoff, total, seen, (hot_g[2], hot_n[2])) if by_others else _plain(base, shared, order, partitions, backoff)
    own = told.select("a", _mark(F.col("t")).alias("m"), "id", "n", "x", F.lit(1).alias("rows"))
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n"), "x", F.lit(0).alias("rows")]
    every = own.unionByName(found.select("a", "m", *none))
    # repeated rows have one key: their sums are divided again
    done = every.groupBy("a", "m").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.sum("x").alias("x"), F.sum("rows").cast("int").alias("rows"))
    done = done.select("id", "n", (F.col("x") / F.col("rows")).alias("x"), F.explode(F.sequence(F.lit(1), F.col("rows"))))
    s = F.when(F.col("n") > 0, F.col("x"))
    return done.select(F.col("id").alias(doc_id), F.col("n").alias("n_words"), F.round(s, 4).alias("log_score"), F.round(s / F.when(F.col("n") > 0, F.col("n")), 4).alias("mean_log_score"))


#: Order 2, plain counts.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_prepend(chr(1) || ' ', ws)[1:len(ws)]) AS v, unnest(ws) AS w FROM t WHERE len(ws) > 0),
c1 AS (SELECT w, count(*) AS c FROM g GROUP BY w UNION ALL SELECT v, count(*) FROM g WHERE v = chr(1) || ' ' GROUP BY v),
n AS (SELECT count(*) AS n FROM g),
c2 AS (SELECT v, w, count(*) AS c FROM g GROUP BY v, w),
s AS (SELECT g.doc_id, count(*) AS n_words, sum(CASE WHEN c2.c IS NOT NULL THEN ln(c2.c) - ln(cv.c) ELSE ln(0.4) + ln(cw.c) - ln((SELECT n FROM n)) END) AS s
      FROM g LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w JOIN c1 cv ON g.v = cv.w JOIN c1 cw ON g.w = cw.w GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, round(s.s, 4) AS log_score, round(s.s / s.n_words, 4) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s ON d.doc_id = s.doc_id
"""

#: Order 3, plain counts.
TRIGRAM_SQL = r"""
WITH t AS (SELECT doc_id, list_prepend(chr(1) || ' ', regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS ws FROM documents),
g AS (SELECT doc_id, unnest(ws[2:]) AS w, unnest(ws[1:len(ws) - 1]) AS v, unnest(list_prepend(NULL, ws[1:len(ws) - 2])) AS u FROM t WHERE len(ws) > 1),
c1 AS (SELECT v, count(*) AS c FROM g WHERE u IS NULL GROUP BY v),
c2 AS (SELECT v, w, count(*) AS c FROM g GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT g.doc_id, count(*) AS n_words, sum(CASE WHEN g.u IS NULL THEN ln(0.4) + ln(c2.c) - ln(c1.c) ELSE ln(c3.c) - ln(p.c) END) AS s
      FROM g JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN c1 ON g.v = c1.v LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w LEFT JOIN c2 p ON g.u = p.v AND g.v = p.w GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, round(s.s, 4) AS log_score, round(s.s / s.n_words, 4) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s ON d.doc_id = s.doc_id
"""
