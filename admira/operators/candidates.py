"""Pairs of applicants and institutions that pass the hard gates, by an equi-join on bins.

An institution stands in a bin by its province and its minimum percentage, and once more in one for applicants who name no
province. An applicant goes to the bins that can fit: the named province and the nameless one, up to the own percentage. A
pair meets in one bin only; bins are dealt to blocks on both sides, so a bin of any size is spread over tasks. The exact
gates are the rest of the join's condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocks import bounded, deal

#: Percentage points of a bin, and the last bin.
WIDTH, TOP = 10, 10
#: Rows of a block, on either side, about.
BLOCK = 4096


def gate(profile: dict[str, Column], entity: dict[str, Column]) -> Column:
    """Drop a pair that is known not to fit: percentage below the minimum, no hostel, another province."""
    pct, least = profile["academic_percentage"], entity["min_eligibility"]
    wanted, own = province(profile["preferred_province"]), province(entity["province"])
    fits = pct.isNull() | least.isNull() | (pct >= least)
    fits &= ~F.coalesce(profile["hostel_required"], F.lit(False)) | F.coalesce(entity["hostel"], F.lit(True))
    return fits & ((wanted == "") | (own == "") | (wanted == own))


def province(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)), F.lit(""))


def bin_of(pct: Column) -> Column:
    top = F.isnan(pct.cast("double"))  # NaN is above all numbers
    return F.when(top, F.lit(TOP)).when(pct.isNotNull(), F.least(F.lit(TOP), F.greatest(F.lit(0), F.floor(pct / WIDTH)))).cast("int")


def gated(p: DataFrame, e: DataFrame, block: int = BLOCK) -> DataFrame:
    """(p, e) of the rows p (a struct with profile_id and the gates' columns) and e (a struct with id and the gates')."""
    wanted, pct = province(F.col("p.preferred_province")), F.col("p.academic_percentage")
    places = F.when(wanted == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), wanted), F.lit("=")))
    bins = F.sequence(F.lit(-1), F.coalesce(bin_of(pct), F.lit(TOP)))
    left = p.select("p", F.explode(places).alias("place")).select("p", "place", F.explode(bins).alias("bin")).select("p", F.struct("place", "bin").alias("cell"))
    own = F.array(F.lit("*"), F.concat(F.lit("="), province(F.col("e.province"))))
    right = e.select("e", F.explode(own).alias("place")).select("e", F.struct("place", F.coalesce(bin_of(F.col("e.min_eligibility")), F.lit(-1)).alias("bin")).alias("cell"))
    left, right = deal(left, right, "cell", "p.profile_id", "e.id", block, block)
    side = lambda name, df: {c: F.col(f"{name}.{c}") for c in df.schema[name].dataType.names}
    return left.join(right, ["cell", "lb", "rb"]).where(gate(side("p", p), side("e", e))).select("p", "e")


def _asked(profiles: DataFrame) -> DataFrame:
    """Applicants by what the gates read: without a percentage they are above all minimums, as NaN is."""
    pct = F.coalesce(F.col("academic_percentage").cast("double") + 0.0, F.lit(float("nan")))
    return profiles.select("profile_id", pct.alias("x"), F.coalesce("hostel_required", F.lit(False)).alias("need"), province(F.col("preferred_province")).alias("place"))


def _offered(entities: DataFrame) -> DataFrame:
    least = F.coalesce(F.col("min_eligibility").cast("double") + 0.0, F.lit(float("-inf")))
    return entities.select("id", least.alias("x"), F.coalesce("hostel", F.lit(True)).alias("lodging"), province(F.col("province")).alias("place"))


def _asking(kinds: DataFrame, *more: str) -> DataFrame:
    """Kinds of applicants in the cells (at, need) where they meet institutions, each in one cell only."""
    at = F.when(F.col("place") == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), "place"), F.lit("=")))
    return kinds.select(F.explode(at).alias("at"), "need", "x", "place", *more)


def _offering(kinds: DataFrame, *more: str) -> DataFrame:
    at, needs = F.array(F.lit("*"), F.concat(F.lit("="), "place")), F.when(F.col("lodging"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return kinds.select(F.explode(at).alias("at"), "x", "lodging", "place", *more).select("at", F.explode(needs).alias("need"), "x", "lodging", "place", *more)


def gated_sums(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """(profile_id, n, ids): how many institutions pass an applicant's gates, and the sum of their ids.

    Rows that agree in what the gates read are one kind; sums up to a kind's percentage are prefix sums, so no pair is made.
    """
    asked = _asked(profiles)
    held = _offering(_offered(entities).groupBy("x", "lodging", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")), "n", "ids")
    wanted = _asking(asked.select("x", "need", "place").distinct())
    none = F.lit(0).cast("long")
    rows = held.select("at", "need", "x", F.lit(None).cast("string").alias("place"), "n", "ids").unionByName(wanted.select("at", "need", "x", "place", none.alias("n"), none.alias("ids")))
    upto = W.partitionBy("at", "need").orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.select("x", "need", "place", F.sum("n").over(upto).alias("n"), F.sum("ids").over(upto).alias("ids")).where("place IS NOT NULL")
    kinds = summed.groupBy("x", "need", "place").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).where("n > 0")
    return asked.join(bounded(kinds), ["x", "need", "place"]).groupBy("profile_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def gated_counts(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, n): how many applicants pass an institution's gates; by kinds and prefix sums, as ``gated_sums``."""
    offered = _offered(entities)
    held = _asking(_asked(profiles).groupBy("x", "need", "place").agg(F.count(F.lit(1)).alias("n")), "n")
    wanted = _offering(offered.select("x", "lodging", "place").distinct())
    rows = held.select("at", "need", "x", F.lit(None).cast("boolean").alias("lodging"), F.lit("").alias("place"), "n").unionByName(wanted.withColumn("n", F.lit(0).cast("long")))
    down = W.partitionBy("at", "need").orderBy(F.desc("x")).rangeBetween(W.unboundedPreceding, W.currentRow)
    kinds = rows.select("x", "lodging", "place", F.sum("n").over(down).alias("n")).where("lodging IS NOT NULL").groupBy("x", "lodging", "place").agg(F.sum("n").alias("n")).where("n > 0")
    return offered.join(bounded(kinds), ["x", "lodging", "place"]).groupBy("id").agg(F.sum("n").alias("n"))
