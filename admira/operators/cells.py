"""Scores of every gated pair of applicants and institutions, block against block.

Both sides are dealt to blocks; a cell of two blocks is read by one task as rows of points: per factor an applicant meets
the distinct values of the block's institutions, and these are spread over the institutions. No pair becomes a row, so the
work is the number of pairs, but what is stored and shuffled grows with the rows of either side and the answer.

``best`` keeps the best institutions of each applicant, ``sums`` adds up an applicant's totals, ``counts`` adds up one
factor's scores over all pairs; for this, rows that agree in what the factor and the gates read are counted first.

``best`` need not score every pair. Applicants who agree in what the location reads are one kind. For a kind an institution
is beaten by one of smaller id that has no fewer points for its place, asks for no more and costs no more: whatever else an
applicant of the kind wants, that one comes first. What as many as ``limit`` others beat is in nobody's list (``thinned``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..functions.geo import EARTH_KM
from ..sources.folders import stage
from .blocks import bounded, deal
from .candidates import province

#: Rows of a block, of pairs that a task scores at a time, and of applicants that a block holds at least.
BLOCK, AT_ONCE, LEAST = 16384, 1 << 18, 256
#: Applicants of a kind from which its institutions are thinned, kinds and institutions that a task thins at a time, the first of its steps.
SHARED, KINDS, THINNED, FIRST = 8, 128, 1 << 17, 1024
#: Rows of a block where no pair is looked at.
PRICED = 1 << 18
#: Course lists and minimums that are told apart in thinning; beyond, rows are kept.
LISTS, LEASTS = 32, 64
#: Points of a pair that a gate refuses: below what all factors add up to.
REFUSED = -10001
_GATES = {"p": ("pct", "hostel", "place"), "e": ("least", "hostel", "place")}
#: What a factor reads besides.
_READS = {
    "program_match": {"p": ("field", "whole", "goals", "has_goals"), "e": ("hits", "across", "has_courses")},
    "eligibility_match": {"p": (), "e": ()},
    "budget_fit": {"p": ("budget",), "e": ("fee",)},
    "scholarship_fit": {"p": ("needs",), "e": ("helps",)},
    "location_fit": {"p": ("cities", "wanted", "lat", "lon"), "e": ("city", "area", "lat", "lon")},
    "goal_alignment": {"p": ("field", "whole", "goals", "has_goals"), "e": ("hits", "across", "has_courses")},
}


def sides(wishes: DataFrame, offers: DataFrame, fee: Column) -> tuple[DataFrame, DataFrame]:
    """Applicants and institutions in the columns that cells read: texts in lower case, gates with their defaults."""
    text, no, number = lambda c: F.lower(F.coalesce(c, F.lit(""))), F.lit(False), lambda c: F.col(c).cast("double")
    p = wishes.select(
        "profile_id", number("academic_percentage").alias("pct"), F.coalesce("hostel_required", no).alias("hostel"), province(F.col("preferred_province")).alias("place"),
        F.transform("preferred_cities", F.lower).alias("cities"), text(F.col("preferred_province")).alias("wanted"), number("latitude").alias("lat"), number("longitude").alias("lon"),
        number("budget_pkr_per_semester").alias("budget"), F.coalesce("scholarship_required", no).alias("needs"), text(F.trim("priority_focus")).alias("priority"), "field", "whole", "goals", "has_goals",
    )
    placed = (F.col("latitude") != 0) & (F.col("longitude") != 0)
    e = offers.select(
        "id", number("min_eligibility").alias("least"), F.coalesce("hostel", F.lit(True)).alias("hostel"), province(F.col("province")).alias("place"),
        text(F.col("city")).alias("city"), text(F.col("province")).alias("area"), F.when(placed, number("latitude")).alias("lat"), F.when(placed, number("longitude")).alias("lon"),
        fee.cast("double").alias("fee"), F.coalesce("has_scholarships", no).alias("helps"), "hits", "across", "has_courses",
    )
    return p, e


def _classes(*columns: list) -> tuple[list[tuple], np.ndarray]:
    """The distinct rows of some columns, and each row's number among them."""
    seen: dict[tuple, int] = {}
    of = np.fromiter((seen.setdefault(k, len(seen)) for k in zip(*columns, strict=True)), np.intp, len(columns[0]))
    return list(seen), of


def _floats(values: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and where they are given."""
    values = list(values)
    return np.array([0.0 if v is None else v for v in values]), np.array([v is not None for v in values], bool)


def _index(n: int) -> type:
    """The smallest type that holds the numbers up to ``n``."""
    return np.int16 if n < 1 << 15 else np.int32


class Cell:
    """A block of applicants against a block of institutions."""

    def __init__(self, p: pa.Table, e: pa.Table):
        self.n, self.m = p.num_rows, e.num_rows
        rows = {c: p.column(c).to_pylist() for c in p.column_names if c not in ("profile_id", "lb", "rb")}
        cols = {c: e.column(c).to_pylist() for c in e.column_names if c not in ("id", "lb", "rb")}
        listed = lambda c: [tuple(x or ()) for x in c]
        #: NaN is above all numbers, as in SQL.
        self.pct, self.has_pct = _floats(rows["pct"])
        self.pct[np.isnan(self.pct)] = np.inf
        self.lodged, self.budget, self.needs = np.array(rows["hostel"], bool), _floats(rows["budget"])[0], np.array(rows["needs"], bool)
        (self.lat, a), (self.lon, b) = _floats(rows["lat"]), _floats(rows["lon"])
        self.here = a & b
        self.wish = list(zip(listed(rows["field"]), rows["whole"], listed(rows["goals"]), rows["has_goals"], strict=True))
        self.area = list(zip(listed(rows["cities"]), rows["wanted"], rows["place"], strict=True))

        least, self.of_least = _classes(cols["least"], cols["hostel"])
        self.least, self.has_least = _floats(k[0] for k in least)
        self.least[np.isnan(self.least)] = np.inf
        self.lodging = np.array([k[1] for k in least], bool)
        self.fee, self.of_fee = np.unique(_floats(cols["fee"])[0], return_inverse=True)  # rising
        self.helps = np.array(cols["helps"], bool)
        spots, of_spot = _classes(cols["lat"], cols["lon"])
        self.north, a = _floats(k[0] for k in spots)
        self.east, b = _floats(k[1] for k in spots)
        self.placed, self.of_spot = a & b, of_spot
        self.areas, of_area = _classes(cols["city"], cols["area"], cols["place"])
        both, self.of_loc = _classes(of_area.tolist(), of_spot.tolist())
        self.loc_area, self.loc_spot = np.array([k[0] for k in both], np.intp), np.array([k[1] for k in both], np.intp)
        held, self.of_held = _classes(listed(cols["hits"]), listed(cols["across"]), cols["has_courses"])
        self.taught = np.array([k[2] for k in held], bool)
        hits: dict[str, list[int]] = {}
        whole: dict[str, list[int]] = {}
        for i, (h, x, _) in enumerate(held):
            for t in h:
                hits.setdefault(t, []).append(i)
            for t in {*h, *x}:
                whole.setdefault(t, []).append(i)
        self.hits, self.whole = hits, whole
        self._wish, self._area = lru_cache(1024)(self._wished), lru_cache(1024)(self._placed)  # of one block at most

    def _wished(self, wish: tuple) -> np.ndarray:
        """Points of the programme and of the goals, for each kind of course list."""
        field, whole, goals, has_goals = wish

        def some(index: dict, phrases: Iterable[str]) -> np.ndarray:
            out = np.zeros(len(self.taught), bool)
            for t in phrases:
                out[index.get(t, [])] = True
            return out

        program = np.full(len(self.taught), 50) if whole == "" else np.where(some(self.hits, field), 100, np.where(self.taught, 35, 40))
        goal = np.full(len(self.taught), 60)
        if has_goals:
            aligned = some(self.whole, [whole] if whole else [])
            goal = np.where(aligned, 90, np.where(some(self.hits, goals), 80, 50))
        return np.array([program, goal], np.int16)

    def _placed(self, area: tuple) -> np.ndarray:
        """Of each city and province: 100 or 85 points, 0 where the distance decides, or refused."""
        cities, wanted, place = area
        out = np.zeros(len(self.areas), np.int16)
        for i, (city, own, theirs) in enumerate(self.areas):
            if place and theirs and place != theirs:
                out[i] = REFUSED
            elif city and any(c is not None and (c in city or city in c) for c in cities):
                out[i] = 100
            elif wanted and own and wanted in own:
                out[i] = 85
        return out

    def km(self, s: slice) -> np.ndarray:
        """Distances to the places of the block; NaN where either is unknown."""
        la, lo = self.lat[s, None], self.lon[s, None]
        a = np.sin(np.radians(self.north - la) / 2) ** 2 + np.cos(np.radians(la)) * np.cos(np.radians(self.north)) * np.sin(np.radians(self.east - lo) / 2) ** 2
        return np.where(self.here[s, None] & self.placed, np.arcsin(np.sqrt(a)) * (2 * EARTH_KM), np.nan)

    def eligibility_match(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        pct, known = self.pct[s, None], self.has_pct[s, None] & self.has_least
        fits = (~known | (pct >= self.least)) & (~self.lodged[s, None] | self.lodging)
        with np.errstate(invalid="ignore"):
            margin = np.nan_to_num(np.maximum(pct - self.least, 0.0), nan=np.inf)
        points = np.where(~known, 60, np.where(margin >= 15, 100, np.floor(np.minimum(margin, 15) * 2) + 70))
        return np.where(fits, points, REFUSED).astype(np.int16), self.of_least

    def budget_fit(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        own, place, points = self.budget[s], np.arange(len(self.fee), dtype=_index(len(self.fee))), np.full((s.stop - s.start, len(self.fee)), 100, np.int16)
        for over, less in ((None, 25), (0.15, 30), (0.35, 25)):  # points fall as fees rise: count the fees before each fall
            points -= (place >= within(self.fee, own, over).astype(place.dtype)[:, None]) * np.int16(less)
        points[own == 0] = 55
        points[:, self.fee == 0] = 55
        return points, self.of_fee

    def scholarship_fit(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.needs[s, None], [25, 100], [60, 80]).astype(np.int16), self.helps.astype(np.intp)

    def location_fit(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        km = self.km(s)
        far = np.where(self.here[s, None] & self.placed, np.where(km <= 8, 95, np.where(km <= 20, 75, 45)), 60).astype(np.int16)
        named = np.stack([self._area(k) for k in self.area[s]])[:, self.loc_area]
        return np.where(named == 0, far[:, self.loc_spot], named), self.of_loc

    def program_match(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([self._wish(k)[0] for k in self.wish[s]]), self.of_held

    def goal_alignment(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([self._wish(k)[1] for k in self.wish[s]]), self.of_held

    def slices(self) -> Iterator[slice]:
        step = max(1, AT_ONCE // self.m)
        return (slice(a, min(a + step, self.n)) for a in range(0, self.n, step))

    def weighed(self, s: slice, weight: dict[str, np.ndarray]) -> np.ndarray:
        """Points times weights of each pair; negative where a gate refuses. Rows of few numbers are copied institution by
        institution, which is faster than number by number."""
        refuse = lambda t, w: np.where(t < 0, np.int16(REFUSED), t * w)
        out = np.zeros((self.m, s.stop - s.start), np.int16)
        for name in _READS:
            if name == "goal_alignment":
                continue  # with the programme
            table, of = getattr(self, name)(s)
            table = refuse(table, weight[name][s, None])
            if name == "program_match":
                table = table + self.goal_alignment(s)[0] * weight["goal_alignment"][s, None]
            out += np.take(np.ascontiguousarray(table.T, np.int16), of, axis=0)
        return np.ascontiguousarray(out.T)

    def points(self, name: str, s: slice) -> np.ndarray:
        """The factor's points of each pair, negative where a gate refuses."""
        table, of = getattr(self, name)(s)
        out = np.take(table, of, axis=1)
        for other in {"eligibility_match", "location_fit"} - {name}:
            table, of = getattr(self, other)(s)
            out = np.where(np.take(table < 0, of, axis=1), np.int16(REFUSED), out)
        return out


def _met(p: DataFrame, e: DataFrame, out: str, read: Callable[[pa.Table, pa.Table], pa.Table], block: int | None = None, least: int | None = None) -> DataFrame:
    """``read`` of every cell of two stored sides, in blocks of ``block`` rows, and of ``least`` applicants at least."""
    block, least = BLOCK if block is None else block, LEAST if least is None else least
    spark, n, m = p.sparkSession, p.count(), e.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rights = max(1, -(-m // block))
    lefts = max(1, -(-n // block), min(-(-n // least), -(-tasks // rights)))
    own = lambda df, parts: F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = p.withColumn("lb", own(p, lefts)).withColumn("rb", every(rights))
    right = e.withColumn("rb", own(e, rights)).withColumn("lb", every(lefts))
    parts = min(lefts * rights, 4096)  # much work for few bytes: not to be coalesced
    left, right = left.repartition(parts, "lb", "rb"), right.repartition(parts, "lb", "rb")
    none = to_arrow_schema(spark.createDataFrame([], out).schema).empty_table()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return read(a, b) if a.num_rows and b.num_rows else none

    return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, out)


def _weights(priority: list[str], sets: dict[str | None, dict[str, int]]) -> dict[str, np.ndarray]:
    return {c: np.array([sets.get(k, sets[None])[c] for k in priority], np.int16) for c in _READS}


def _rounded(weighed: np.ndarray) -> np.ndarray:
    """Hundredths rounded half to even; -1 for the refused."""
    up = weighed + np.int16(50)
    out = up // np.int16(100)
    out -= (up == out * np.int16(100)) & ((out & np.int16(1)) == 1)
    return np.where(weighed < 0, np.int16(-1), out)


def best(p: DataFrame, e: DataFrame, sets: dict[str | None, dict[str, int]], limit: int, plain: int = 0) -> DataFrame:
    """(profile_id, id, total_score, program, goal, rank): the ``limit`` best of each applicant, ties to the smaller id, with
    the points of the programme and of the goals.

    Up to ``plain`` institutions, and for kinds of few applicants, every pair is scored.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("profile_id", p), ("id", e))}
    out = f"profile_id {kinds['profile_id']}, id {kinds['id']}, total_score int, program int, goal int"
    own = W.partitionBy("profile_id").orderBy(F.desc("total_score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= limit)

    def read(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")  # places tell ids apart
        cell, weight = Cell(a, b), _weights(a.column("priority").to_pylist(), sets)
        kind, bits = (np.int32, 24) if cell.m < 1 << 24 else (np.int64, 32)  # a total takes seven bits
        back, k, made = np.arange(cell.m, dtype=kind)[::-1], min(limit, cell.m), []
        for s in cell.slices():
            key = (_rounded(cell.weighed(s, weight)).astype(kind) << bits) + back
            top = np.partition(key, cell.m - k, axis=1)[:, cell.m - k :]
            at, _ = np.nonzero(top >= 0)
            top = top[top >= 0]
            places = cell.m - 1 - (top & ((1 << bits) - 1))
            program, held = cell.program_match(s)
            made.append((at + s.start, places, (top >> bits).astype(np.int32), *(t[at, held[places]].astype(np.int32) for t in (program, cell.goal_alignment(s)[0]))))
        rows, places, total, program, goal = (np.concatenate(x) for x in zip(*made, strict=True))
        take = lambda t, c, at: t.column(c).combine_chunks().take(pa.array(at))
        return pa.table({"profile_id": take(a, "profile_id", rows), "id": take(b, "id", places), "total_score": total, "program": program, "goal": goal})

    if e.limit(plain + 1).count() <= plain:
        return ranked(_met(p, e, out, read))
    place = F.to_json(F.struct(*_PLACE))  # tells apart whatever differs
    known = stage(p.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).withColumn("key", place).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    shared = known.where(F.col("n") >= SHARED)
    of = p.withColumn("key", place).join(bounded(shared.select("key", "kind")), "key", "left").drop("key")
    found = ranked(_met(of.where("kind IS NULL").drop("kind"), e, out, read))
    if shared.isEmpty():
        return found
    kept = stage(thinned(shared.select("kind", *_PLACE), e, limit), "kept")
    left, right = deal(of.where("kind IS NOT NULL"), kept.join(e.hint("shuffle_hash"), "id"), "kind", "profile_id", "id", BLOCK, BLOCK)
    cell, none = ["kind", "lb", "rb"], to_arrow_schema(p.sparkSession.createDataFrame([], out).schema).empty_table()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return read(a.drop_columns(["kind"]), b.drop_columns(["kind"])) if a.num_rows and b.num_rows else none

    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4  # much work for few bytes: not to be coalesced
    met = left.repartition(parts, *cell).groupBy(*cell).cogroup(right.repartition(parts, *cell).groupBy(*cell)).applyInArrow(meet, out)
    return found.unionByName(ranked(met))


#: What the location reads of an applicant, and thinning of an institution.
_PLACE = ("cities", "wanted", "place", "lat", "lon")
_THIN = ("id", "least", "hostel", "place", "city", "area", "lat", "lon", "fee", "helps")


def thinned(kinds: DataFrame, e: DataFrame, limit: int) -> DataFrame:
    """(kind, id): of each kind (kind, cities, wanted, place, lat, lon) the institutions that can be in a list of ``limit``."""
    spark, n, m = kinds.sparkSession, kinds.count(), e.count()
    lefts, rights = max(1, -(-n // KINDS)), max(1, -(-m // THINNED))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = F.to_json(F.struct(F.array_sort("hits").alias("h"), F.array_sort("across").alias("x"), "has_courses"))
    left = kinds.withColumn("lb", F.pmod(F.xxhash64("kind"), F.lit(lefts)).cast("int")).withColumn("rb", every(rights))
    right = e.select(*_THIN, held.alias("held")).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(rights)).cast("int")).withColumn("lb", every(lefts))
    parts = min(lefts * rights, 4096)
    out = f"kind long, id {e.schema['id'].dataType.simpleString()}"
    none = to_arrow_schema(spark.createDataFrame([], out).schema).empty_table()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return none
        b = b.sort_by("id")
        thin, ids, made = Thin(a, b, limit), b.column("id").combine_chunks(), []
        for i, kind in enumerate(a.column("kind").to_pylist()):
            at = thin.kept(i)
            made.append(pa.table({"kind": pa.array(np.full(len(at), kind, np.int64)), "id": ids.take(pa.array(at))}))
        return pa.concat_tables(made)

    return left.repartition(parts, "lb", "rb").groupBy("lb", "rb").cogroup(right.repartition(parts, "lb", "rb").groupBy("lb", "rb")).applyInArrow(meet, out)


class Thin:
    """Institutions, by rising id, that kinds of applicants can have among their best ``limit``."""

    def __init__(self, kinds: pa.Table, e: pa.Table, limit: int):
        n, m = kinds.num_rows, e.num_rows
        same = lambda value, rows: pa.array([value] * rows)
        p = pa.table({c: kinds.column(c) for c in _PLACE} | {c: same(v, n) for c, v in (("pct", None), ("hostel", False), ("budget", None), ("needs", False), ("field", []), ("whole", ""), ("goals", []), ("has_goals", False))})
        own = pa.table({c: e.column(c) for c in _THIN} | {c: same(v, m) for c, v in (("hits", []), ("across", []), ("has_courses", False))})
        self.cell, self.limit = Cell(p, own), limit
        fee, given = e.column("fee").to_numpy(), np.array(e.column("least").is_valid())
        self.fee = np.nan_to_num(fee, nan=0.0, posinf=np.inf, neginf=-np.inf)  # none counts as 0
        least = np.where(given, np.nan_to_num(e.column("least").to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf), 0.0)
        levels, of = np.unique(least, return_inverse=True)
        step = -(-len(levels) // LEASTS)
        self.level, self.levels = of // step, -(-len(levels) // step)
        self.coarse = step > 1  # a level of several minimums: only lower levels beat its rows
        code = e.column("held").combine_chunks().dictionary_encode()
        lists, many = code.indices.to_numpy(), np.bincount(code.indices.to_numpy())
        common = np.full(len(many), -1)
        common[np.argsort(-many, kind="stable")[:LISTS]] = np.arange(min(LISTS, len(many)))
        apart = (common[lists] * 2 + (self.fee == 0)) * 2 + given
        self.free = common[lists] >= 0
        groups, self.group = np.unique(np.where(self.free, apart, -1), return_inverse=True)
        self.shape = (len(groups), len(_NEAR), 2, 2, self.levels)
        self.rest = np.ravel_multi_index((self.group, np.zeros(m, np.intp), (~np.array(e.column("hostel").to_pylist(), bool)).astype(np.intp), (~np.array(e.column("helps").to_pylist(), bool)).astype(np.intp), self.level), self.shape)

    def kept(self, i: int) -> np.ndarray:
        """The rows that fewer than ``limit`` others beat for sure; refused places are left out."""
        table, of = self.cell.location_fit(slice(i, i + 1))
        near = np.searchsorted(-_NEAR, -table[0])  # 0 for the most points
        open_ = np.flatnonzero((table[0] >= 0)[of])
        where = self.rest[open_] + near[of[open_]] * (4 * self.levels)
        fee, free = self.fee[open_], self.free[open_]
        kept, begin, size = [], 0, FIRST
        while begin < len(open_):
            rows = np.arange(begin, min(begin + size, len(open_)))
            if kept:
                lowest = self._lowest(np.concatenate([fee[k] for k in kept]), np.concatenate([where[k] for k in kept]))
                rows = rows[(fee[rows] < lowest[where[rows]]) | ~free[rows]]
            kept.append(rows)
            begin, size = begin + size, size * 3
        return open_[np.concatenate(kept)] if kept else open_

    def _lowest(self, fee: np.ndarray, where: np.ndarray) -> np.ndarray:
        """For each place in the shape the fee that ``limit`` rows in it, or in places that beat it, don't exceed."""
        k, order = self.limit, np.lexsort((fee, where))
        fee, where = fee[order], where[order]
        nth = np.arange(len(where)) - np.searchsorted(where, where)
        low = np.full((int(np.prod(self.shape)), k), np.inf)
        low[where[nth < k], nth[nth < k]] = fee[nth < k]
        low = low.reshape(*self.shape, k)
        for axis in (1, 2, 3, 4):  # each row is in one of two merged lists only
            side = np.moveaxis(low, axis, 0)
            for j in range(1, len(side)):
                side[j] = np.partition(np.concatenate([side[j - 1], side[j]], axis=-1), k - 1, axis=-1)[..., :k]
        last = low.max(axis=-1)
        if self.coarse:
            last = np.concatenate([np.full_like(last[..., :1], np.inf), last[..., :-1]], axis=-1)
        return last.ravel()


#: The points that a place can have, the most first.
_NEAR = np.array([100, 95, 85, 75, 60, 45])


def sums(p: DataFrame, e: DataFrame, sets: dict[str | None, dict[str, int]]) -> DataFrame:
    """(profile_id, n, total, best, farthest) of each applicant's gated pairs: how many, their totals, the largest distance."""
    kind = p.schema["profile_id"].dataType.simpleString()

    def read(a: pa.Table, b: pa.Table) -> pa.Table:
        cell, weight, made = Cell(a, b), _weights(a.column("priority").to_pylist(), sets), []
        for s in cell.slices():
            score, km = _rounded(cell.weighed(s, weight)), np.nan_to_num(cell.km(s), nan=-1.0)
            order = np.argsort(km, axis=1)
            place = np.empty(km.shape, np.int32)
            np.put_along_axis(place, order, np.arange(km.shape[1], dtype=np.int32)[None], axis=1)
            last = np.where(score >= 0, np.take(place, cell.of_spot, axis=1), -1).max(axis=1)
            far = np.where(last < 0, -1.0, np.take_along_axis(km, np.take_along_axis(order, np.maximum(last, 0)[:, None], axis=1), axis=1)[:, 0])
            made.append((np.count_nonzero(score >= 0, axis=1), np.maximum(score, 0).sum(axis=1, dtype=np.int64), score.max(axis=1), far))
        n, total, top, far = (np.concatenate(x) for x in zip(*made, strict=True))
        some = pa.array(n > 0)
        out = pa.table({"profile_id": a.column("profile_id").combine_chunks(), "n": n, "total": total, "best": top.astype(np.int32), "farthest": pa.array(far, mask=far < 0)})
        return out.filter(some)

    found = _met(p, e, f"profile_id {kind}, n long, total long, best int, farthest double", read)
    return found.groupBy("profile_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"), F.max("farthest").alias("farthest"))


def reads_courses(name: str) -> bool:
    """Whether a factor asks what course lists hold."""
    return "hits" in _READS[name]["e"]


class Ranks:
    """Numbers in order, to be summed by weights over those of a beginning that are below a bound: a wavelet matrix."""

    def __init__(self, values: np.ndarray, *weights: np.ndarray):
        self.levels, order = [], np.arange(len(values))
        for bit in reversed(range(max(1, int(values.max(initial=0)).bit_length()))):
            low = (values[order] >> bit) & 1 == 0
            sums = [np.concatenate([[0], np.cumsum(np.where(low, w[order], 0))]) for w in weights]
            self.levels.append((bit, np.concatenate([[0], np.cumsum(low)]), sums))
            order = np.concatenate([order[low], order[~low]])
        self.whole = [np.concatenate([[0], np.cumsum(w)]) for w in weights]

    def below(self, first: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """Of each question the weights of the ``first`` numbers that are less than ``bound``."""
        out = [np.zeros(len(first), w.dtype) for w in self.whole]
        a, b = np.zeros(len(first), np.intp), first.astype(np.intp)
        for bit, low, sums in self.levels:
            one, la, lb = (bound >> bit) & 1 == 1, low[a], low[b]
            for o, s in zip(out, sums, strict=True):
                o += np.where(one, s[b] - s[a], 0)
            a, b = np.where(one, low[-1] + a - la, la), np.where(one, low[-1] + b - lb, lb)
        all_ = bound >= 1 << len(self.levels)
        return [np.where(all_, w[first], o) for o, w in zip(out, self.whole, strict=True)]


def priced_pairs(a: pa.Table, b: pa.Table) -> dict[int, tuple[int, int]]:
    """Of each score of the budget the number of gated pairs and the sum of ids, of kinds counted by ``n`` and ``ids``.

    Institutions that an applicant's gates let through are a beginning in the order of their minimums, and scores fall as
    fees rise, so a pair is never looked at.
    """
    text = lambda t, c: np.array(t.column(c).to_pylist(), object)
    own, pct, has_pct = _floats(a.column("budget").to_pylist())[0], *_floats(a.column("pct").to_pylist())
    pct = np.where(has_pct, np.where(np.isnan(pct), np.inf, pct), np.inf)  # none is above all minimums
    least, has_least = _floats(b.column("least").to_pylist())
    least = np.where(has_least, np.where(np.isnan(least), np.inf, least), -np.inf)
    fee, places, many, ids = _floats(b.column("fee").to_pylist())[0], text(b, "place"), np.asarray(b.column("n")).astype(np.int64), np.asarray(b.column("ids")).astype(np.int64)
    lodging, lodged, wanted, rows = np.array(b.column("hostel").to_pylist(), bool), np.array(a.column("hostel").to_pylist(), bool), text(a, "place"), np.asarray(a.column("n"))
    scores = (100, 75, 45, 20, 55)
    out = dict.fromkeys(scores, (0, 0))
    for place in set(wanted.tolist()):
        for need in (False, True):
            asks = np.flatnonzero((wanted == place) & (lodged == need))
            open_ = np.flatnonzero(((places == place) | (places == "") | (place == "")) & (lodging | (not need)))
            if not (len(asks) and len(open_)):
                continue
            open_ = open_[np.argsort(least[open_], kind="stable")]
            fees, rank = np.unique(fee[open_], return_inverse=True)
            first, budget = np.searchsorted(least[open_], pct[asks], side="right"), own[asks]
            free = fees[rank] == 0
            n, total = many[open_], ids[open_]
            ranks = Ranks(rank, np.where(free, 0, n), np.where(free, 0, total))
            known, every = budget != 0, [np.concatenate([[0], np.cumsum(w)])[first] for w in (n, total)]
            given = [np.concatenate([[0], np.cumsum(np.where(free, 0, w))])[first] for w in (n, total)]
            upto = [ranks.below(first, within(fees, budget, over)) for over in (None, 0.15, 0.35)]
            upto = [[np.zeros_like(every[0])] * 2, *upto, given]
            for score, low, high in zip(scores, upto, upto[1:]):
                _add(out, score, rows[asks], [np.where(known, h - o, 0) for h, o in zip(high, low, strict=True)])
            _add(out, 55, rows[asks], [np.where(known, w - g, w) for w, g in zip(every, given, strict=True)])
    return {k: v for k, v in out.items() if v[0]}


def _add(out: dict[int, tuple[int, int]], score: int, rows: np.ndarray, found: list[np.ndarray]) -> None:
    n, ids = (int(rows @ w) for w in found)
    out[score] = out[score][0] + n, out[score][1] + ids


def within(fees: np.ndarray, own: np.ndarray, over: float | None) -> np.ndarray:
    """For each budget the number of rising fees that are within it, or above it by no more than the share ``over``."""
    low, high = np.zeros(len(own), np.int32), np.full(len(own), len(fees), np.int32)
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(fees) - 1)
        fee = fees[mid]
        with np.errstate(divide="ignore", invalid="ignore"):
            fits = (fee <= own) if over is None else (fee <= own) | ((fee - own) / own <= over)
        low, high = np.where((low < high) & fits, mid + 1, low), np.where((low < high) & ~fits, mid, high)
    return low


def counts(p: DataFrame, e: DataFrame, name: str) -> DataFrame:
    """(score, n, ids): of a factor's scores, how many gated pairs have it and the sum of their institutions' ids."""
    reads = _READS[name]

    def kinds(df: DataFrame, side: str, *summed: Column) -> DataFrame:
        #: the gates read the place together with the location's columns; what isn't read is one value
        read = {*_GATES[side], *reads[side]}
        kept = lambda c, t: F.col(c) if c in read else (F.lit(None) if t.startswith("array") or t == "double" else F.lit(False) if t == "boolean" else F.lit("")).cast(t).alias(c)
        columns = [(c, t) for c, t in df.dtypes if c not in ("profile_id", "id")]
        rows = df.select(*[kept(c, t) for c, t in columns], *(["id"] if side == "e" else []))
        return stage(rows.groupBy(*[c for c, _ in columns]).agg(F.count(F.lit(1)).alias("n"), *summed), "kinds")

    def read(a: pa.Table, b: pa.Table) -> pa.Table:
        cell, out = Cell(a.drop_columns(["n"]), b.drop_columns(["n", "ids"])), {}
        rows, many, ids = (np.asarray(t.column(c)) for t, c in ((a, "n"), (b, "n"), (b, "ids")))
        for s in cell.slices():
            points = cell.points(name, s)
            for score in np.unique(points).tolist():
                if score >= 0:
                    each = (rows[s].astype(float) @ (points == score)).astype(np.int64)  # applicants of each kind: whole numbers
                    n, total = out.get(score, (0, 0))
                    out[score] = n + int(each @ many), total + int(each @ ids)
        return pa.table({"score": pa.array(list(out), pa.int32()), "n": pa.array([v[0] for v in out.values()], pa.int64()), "ids": pa.array([v[1] for v in out.values()], pa.int64())})

    def priced(a: pa.Table, b: pa.Table) -> pa.Table:
        found = priced_pairs(a, b)
        return pa.table({"score": pa.array(list(found), pa.int32()), "n": pa.array([v[0] for v in found.values()], pa.int64()), "ids": pa.array([v[1] for v in found.values()], pa.int64())})

    left, right = kinds(p, "p"), kinds(e, "e", F.sum("id").alias("ids"))
    if name == "budget_fit":  # only what is read, as the institutions go to every block
        left, right = left.select(*_GATES["p"], "budget", "n"), right.select(*_GATES["e"], "fee", "n", "ids")
        found = _met(left, right, "score int, n long, ids long", priced, PRICED, PRICED // 16)
    else:
        found = _met(left, right, "score int, n long, ids long", read)
    return found.groupBy("score").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
