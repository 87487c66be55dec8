"""Dashboard aggregates over the institutions' view (``entity_view``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules

FEE_BUCKETS = ["Under 50k", "50k – 150k", "150k – 400k", "400k+", "Per credit hour", "No fee listed"]


def has_fee() -> Column:
    return F.col("fee_amount").isNotNull() & (F.coalesce("fee_amount", F.lit(0)) != 0)


def per_credit() -> Column:
    return F.lower(F.coalesce("fee_period", F.lit(""))).contains("credit")


def tri_state_counts(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.count_if(c).alias("yes"), F.count_if(~c).alias("no"), F.count_if(c.isNull()).alias("unknown"))


def fee_buckets(rows: DataFrame) -> DataFrame:
    """(pos, label, n) in fixed order; empty buckets stay. Fees per credit hour stand apart."""
    n = F.col("fee_amount")
    which = F.when(~has_fee(), 5).when(per_credit(), 4).when(n < 50_000, 0).when(n < 150_000, 1).when(n < 400_000, 2).otherwise(3)
    counts = rows.agg(*[F.count_if(which == i).alias(f"b{i}") for i in range(len(FEE_BUCKETS))])
    made = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.col(f"b{i}").alias("n")) for i, label in enumerate(FEE_BUCKETS)])
    return counts.select(F.inline(made))


def period_mix(rows: DataFrame) -> DataFrame:
    name = F.initcap(F.trim(F.replace(F.when(F.coalesce("fee_period", F.lit("")) == "", "unspecified").otherwise(F.col("fee_period")), F.lit("_"), F.lit(" "))))
    return rows.groupBy(F.when(~has_fee(), "No fee listed").otherwise(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def field_completeness(rows: DataFrame) -> DataFrame:
    """(pos, label, percent) of rows in which a field is given, by the field's own rule."""
    rules_ = [("Fee", has_fee()), ("Eligibility %", F.col("eligibility").isNotNull() & (F.coalesce("eligibility", F.lit(0)) != 0)), ("Hostel flag", F.col("hostel").isNotNull()), ("Sector flag", F.col("is_public").isNotNull()), ("Website", F.coalesce("website", F.lit("")) != ""), ("Programs", F.col("program_count") > 0)]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"c{i}") for i, (_, r) in enumerate(rules_)])
    share = lambda i: F.when(F.col("n") > 0, F.bround(F.col(f"c{i}") * F.lit(100.0) / F.col("n"), 1)).otherwise(0.0)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), share(i).alias("percent")) for i, (label, _) in enumerate(rules_)])))


def theme_counts(rows: DataFrame, themes=rules.PROGRAM_THEMES, limit: int = 8) -> DataFrame:
    """(place, label, n): institutions whose shown programmes hold a word of a theme; ties in the themes' order."""
    blob = F.lower(F.array_join("programs", " "))
    hit = lambda words: F.lit(False) if not words else blob.contains(words[0]) | hit(words[1:])
    counts = rows.agg(*[F.count_if(hit(list(words))).alias(f"t{i}") for i, (_, words) in enumerate(themes)])
    made = F.array(*[F.struct((-F.col(f"t{i}")).alias("down"), F.lit(i).alias("pos"), F.lit(label).alias("label")) for i, (label, _) in enumerate(themes)])
    return counts.select(F.posexplode(F.slice(F.array_sort(made), 1, limit)).alias("place", "t")).select((F.col("place") + 1).alias("place"), "t.label", (-F.col("t.down")).alias("n"))


def fee_vs_eligibility(rows: DataFrame) -> DataFrame:
    """Points with both values; a credit hour is estimated at 15 to a semester."""
    y = F.when(per_credit(), F.col("fee_amount") * 15.0).otherwise(F.col("fee_amount").cast("double"))
    period = F.replace(F.when(F.coalesce("fee_period", F.lit("")) == "", "unspecified").otherwise(F.col("fee_period")), F.lit("_"), F.lit(" "))
    return rows.where(has_fee() & F.col("eligibility").isNotNull()).select("id", F.col("eligibility").alias("x"), y.alias("y"), F.col("name").alias("label"), period.alias("period"), per_credit().alias("estimated"))


def entity_matrix(rows: DataFrame) -> DataFrame:
    estimate = F.when(has_fee(), F.when(per_credit(), F.col("fee_amount") * 15.0).otherwise(F.col("fee_amount").cast("double")))
    return rows.select("id", "name", F.coalesce("fee_label", F.lit("—")).alias("fee_label"), estimate.alias("semester_est"), "eligibility", "hostel", "is_public", F.col("has_scholarships").alias("scholarships"), F.col("program_count").alias("programs"))


def _upper_median(rows: DataFrame, column: str) -> DataFrame:
    """The value at place floor(n/2), counted from 0, of the sorted column: from counts of the distinct values."""
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy("v")))  # a row for each distinct count
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return upto.join(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.coalesce(F.min("v"), F.lit(0)).alias("median_programs"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of totals and averages; the mean fee mixes periods, the median of an even number is the upper one."""
    known = F.when(has_fee(), F.col("fee_amount").cast("double"))
    one = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_public")).alias("public"),
        F.count_if(~F.col("is_public")).alias("private"),
        F.count_if(F.col("hostel")).alias("hostel_yes"),
        F.count_if(F.col("has_scholarships")).alias("scholarships"),
        F.bround(F.sum(known) / F.count(known), 0).alias("avg_fee"),
        F.count(known).alias("fee_coverage"),
        F.bround(F.sum("eligibility") / F.count("eligibility"), 1).alias("avg_eligibility"),
    )
    return one.join(F.broadcast(_upper_median(rows, "program_count")))


def insights(rows: DataFrame) -> DataFrame:
    """(pos, sentence): what stands out, in order; extremes go to the first row by name."""
    semester = has_fee() & ~per_credit()
    missing = ~has_fee() | F.col("eligibility").isNull()
    first = F.struct("name", F.col("id").cast("string"))
    low = F.min(F.when(semester, F.struct(F.col("fee_amount").alias("v"), "name", "id")))
    high = F.min(F.when(semester, F.struct((-F.col("fee_amount")).alias("v"), "name", "id")))
    hard = F.min(F.when(F.col("eligibility").isNotNull(), F.struct((-F.col("eligibility")).alias("v"), "name", "id")))
    wide = F.min(F.struct((-F.col("program_count")).alias("v"), "name", "id"))
    s = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_public")).alias("public"), F.count_if(~F.col("is_public")).alias("private"), F.count_if(F.col("hostel")).alias("hostel_yes"), low.alias("low"), high.alias("high"), hard.alias("hard"), wide.alias("wide"), F.count_if(missing).alias("incomplete"), F.min(first).alias("f"))
    t = lambda c: F.col(c).cast("string")
    pkr = lambda c: F.format_number(c, 0)
    lines = [
        F.when(F.col("private") > F.col("public"), F.concat(F.lit("Private schools dominate this dataset ("), t("private"), F.lit(" private vs "), t("public"), F.lit(" public)."))),
        F.when(F.col("hostel_yes") < F.col("total") / 2, F.concat(F.lit("Only "), t("hostel_yes"), F.lit(" of "), t("total"), F.lit(" schools clearly list on-campus hostel options — commute or private housing planning matters for many applicants."))),
        F.when(F.col("low").isNotNull(), F.concat(F.lit("Among semester-style fees, "), F.col("low.name"), F.lit(" looks lowest ("), pkr(F.col("low.v")), F.lit(" PKR) and "), F.col("high.name"), F.lit(" highest ("), pkr(-F.col("high.v")), F.lit(" PKR)."))),
        F.when(F.col("hard").isNotNull(), F.concat(F.lit("Strictest listed eligibility cut-off is "), F.col("hard.name"), F.lit(" at "), (-F.col("hard.v")).cast("string"), F.lit("%."))),
        F.when(F.col("incomplete") > 0, F.concat(t("incomplete"), F.lit(" school(s) are missing fee or eligibility figures — ask for those specifics."))),
        F.when(F.col("wide.v") < 0, F.concat(F.col("wide.name"), F.lit(" has the widest indexed program list ("), (-F.col("wide.v")).cast("string"), F.lit(" entries)."))),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("pos"), line.alias("sentence")) for i, line in enumerate(lines)])
    return s.select(F.inline(F.filter(made, lambda x: x["sentence"].isNotNull())))


def series_per_entity(rows: DataFrame) -> DataFrame:
    """(series, id, label, value, period): the fees, eligibility and programmes of each institution."""
    period = F.when(F.coalesce("fee_period", F.lit("")) == "", "unspecified").otherwise(F.col("fee_period"))
    made = F.array(
        F.struct(F.lit("fees").alias("series"), F.when(has_fee(), F.col("fee_amount").cast("double")).alias("value"), F.replace(period, F.lit("_"), F.lit(" ")).alias("period")),
        F.struct(F.lit("eligibility").alias("series"), F.col("eligibility").cast("double").alias("value"), F.lit(None).cast("string").alias("period")),
        F.struct(F.lit("programs").alias("series"), F.col("program_count").cast("double").alias("value"), F.lit(None).cast("string").alias("period")),
    )
    return rows.select("id", F.col("name").alias("label"), F.inline(made)).where("value IS NOT NULL").select("series", "id", "label", "value", "period")


def missing_value_report(rows: DataFrame) -> DataFrame:
    """(field, names): who lacks a fee or an eligibility figure. The list is a report; it holds a name for each gap."""
    gaps = F.array_compact(F.array(F.when(~has_fee(), F.lit("fee")), F.when(F.col("eligibility").isNull(), F.lit("eligibility"))))
    return rows.select("name", F.explode(gaps).alias("field")).groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
