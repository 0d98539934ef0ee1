"""Business questions: scorecard, occupancy, rates, margins, bands, load.

Group columns that are not on the facts are reached through ``hops`` (see ``rollups``): facts are summed per
foreign key before each join, never after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import (
    bin_index, bin_label, day_type, half_up, mean, percent, rate_of_known_pct, rate_pct, ratio, upper_bands,
    width_bucket, z_score,
)
from opslens.operators.joins import join_lookup, settle
from opslens.operators.rollups import Hop, sums_along

# Bin edges and labels of the published results.
SCORE_EDGES = [0, 20, 40, 60, 80, 100]
SCORE_LABELS = ["0-20", "20-40", "40-60", "60-80", "80-100"]
WAIT_BANDS = [(15, "<15 min"), (30, "15-30 min"), (60, "30-60 min")]
WAIT_LAST = "60+ min"
WAIT_EDGES = [-1, 15, 30, 60, 10000]
WAIT_LABELS = ["<15 min", "15-30 min", "30-60 min", "60+ min"]


def scorecard(
    stays: DataFrame, surveys: DataFrame, billing: DataFrame,
    *, stay: str, flag: str, wait: str, efficiency: str, score: str, gross: str,
) -> DataFrame:
    """One row of headline figures; the survey and billing figures are scalar subqueries."""
    satisfaction = surveys.agg(half_up(mean(F.col(score)), 1).alias("v"))
    billings = billing.agg(half_up(F.sum(gross), 0).alias("v"))
    return stays.agg(
        F.count(F.lit(1)).alias("total_admissions"),
        half_up(mean(F.col(stay)), 2).alias("avg_los_days"),
        half_up(rate_pct(F.col(flag)), 2).alias("readmission_rate_pct"),
        half_up(mean(F.col(wait)), 1).alias("avg_wait_minutes"),
        half_up(mean(F.col(efficiency)), 1).alias("avg_discharge_efficiency"),
    ).withColumns({"avg_satisfaction": satisfaction.scalar(), "gross_billings": billings.scalar()})


def occupancy(
    facts: DataFrame, hops: Sequence[Hop], name: str, capacity: str, stay: Column, window_days: int = 1096
) -> DataFrame:
    """Stay days over capacity days in percent, per group."""
    days = sums_along(facts, hops, [name, capacity], {"total_bed_days": stay})
    share = percent(F.col("total_bed_days"), F.col(capacity) * F.lit(window_days))
    return days.select(
        name, capacity, half_up(F.col("total_bed_days"), 1).alias("total_bed_days"),
        half_up(share, 1).alias("occupancy_rate_pct"),
    ).orderBy(F.desc("occupancy_rate_pct"), name)


def rate_by_width_bucket(
    facts: DataFrame, score: str, flag: str, low: float = 0, high: float = 100, buckets: int = 5
) -> DataFrame:
    """Flag rate per left-closed equal-width bucket; numbers 0 and buckets + 1 take what is out of range."""
    bucket = width_bucket(F.col(score), low, high, buckets).alias("efficiency_bucket")
    return facts.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("admissions"), half_up(rate_pct(F.col(flag)), 2).alias("readmission_rate_pct")
    ).orderBy("efficiency_bucket")


def rate_by_cut(
    facts: DataFrame, score: str, flag: str, edges: Sequence[float] = SCORE_EDGES, labels: Sequence[str] = SCORE_LABELS
) -> DataFrame:
    """Flag rate per right-closed labelled bin; rows outside the edges and unknown flags are left out."""
    value = F.col(score)
    binned = facts.select(bin_index(value, edges).alias("_bin"), bin_label(value, edges, labels).alias("bucket"), flag)
    rates = binned.where(F.col("_bin").isNotNull()).groupBy("_bin", "bucket").agg(
        F.count(flag).alias("admissions"), half_up(rate_of_known_pct(F.col(flag)), 2).alias("readmission_rate_pct")
    )
    return rates.orderBy("_bin").drop("_bin")


def wait_by_day_type(facts: DataFrame, date: str, wait: str) -> DataFrame:
    return facts.groupBy(day_type(F.col(date)).alias("day_type")).agg(
        half_up(mean(F.col(wait)), 1).alias("avg_wait_minutes"), F.count(F.lit(1)).alias("admissions")
    )


def margin_by_group(billing: DataFrame, hops: Sequence[Hop], name: str, gross: Column, cost: Column) -> DataFrame:
    """Billings, cost, margin and margin in percent of billings."""
    sums = sums_along(billing, hops, [name], {"g": gross, "c": cost, "m": gross - cost})
    return sums.select(
        name,
        half_up(F.col("g"), 0).alias("gross_billings"),
        half_up(F.col("c"), 0).alias("operating_cost"),
        half_up(F.col("m"), 0).alias("gross_margin"),
        half_up(percent(F.col("m"), F.col("g")), 1).alias("margin_pct"),
    ).orderBy(F.desc("gross_margin"), name)


def financials(billing: DataFrame, hops: Sequence[Hop], name: str, gross: Column, cost: Column) -> DataFrame:
    return margin_by_group(billing, hops, name, gross, cost).select(name, "gross_billings", "gross_margin")


def cost_by_type(items: DataFrame, hops: Sequence[Hop], kind: str, cost: Column) -> DataFrame:
    """How often each procedure was done and its mean cost."""
    one = F.lit(1).cast("long")
    sums = sums_along(items, hops, [kind], {"n": one, "known": F.when(cost.isNotNull(), one), "total": cost})
    return sums.select(
        kind, F.col("n").alias("times_performed"), half_up(ratio(F.col("total"), F.col("known")), 2).alias("avg_cost")
    ).orderBy(F.desc("avg_cost"), kind)


def _scores_with_wait(surveys: DataFrame, stays: DataFrame, key: str, score: str, wait: str) -> DataFrame:
    """Score sums per stay next to the stay's wait."""
    per_stay = surveys.groupBy(key).agg(
        F.sum(score).alias("total"), F.count(score).alias("known"), F.count(F.lit(1)).alias("n")
    )
    return per_stay.join(stays.select(key, F.col(wait).alias("wait")), key)


def score_by_wait_case(surveys: DataFrame, stays: DataFrame, key: str, score: str, wait: str) -> DataFrame:
    """Mean score per wait band with exclusive upper bounds, shortest waits first."""
    joined = _scores_with_wait(surveys, stays, key, score, wait)
    bands = joined.groupBy(upper_bands(F.col("wait"), WAIT_BANDS, WAIT_LAST).alias("wait_band")).agg(
        half_up(ratio(F.sum("total"), F.sum("known")), 1).alias("avg_satisfaction"),
        F.sum("n").alias("responses"),
        F.min("wait").alias("_first"),
    )
    return bands.orderBy("_first").drop("_first")


def score_by_wait_cut(
    surveys: DataFrame, stays: DataFrame, key: str, score: str, wait: str,
    edges: Sequence[float] = WAIT_EDGES, labels: Sequence[str] = WAIT_LABELS,
) -> DataFrame:
    """Mean score per right-closed wait band."""
    joined = _scores_with_wait(surveys, stays, key, score, wait)
    value = F.col("wait")
    banded = joined.withColumns({"_bin": bin_index(value, edges), "wait_band": bin_label(value, edges, labels)})
    bands = banded.where(F.col("_bin").isNotNull()).groupBy("_bin", "wait_band").agg(
        half_up(ratio(F.sum("total"), F.sum("known")), 1).alias("avg_satisfaction"), F.sum("known").alias("responses")
    )
    return bands.orderBy("_bin").drop("_bin")


def means_by_wait(rows: DataFrame, score: Column, wait: Column, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Mean score per right-closed wait band of rows that hold both."""
    banded = rows.select(bin_index(wait, edges).alias("_bin"), bin_label(wait, edges, labels).alias("wait_band"), score.alias("_score"))
    bands = banded.where(F.col("_bin").isNotNull()).groupBy("_bin", "wait_band").agg(
        half_up(ratio(F.sum("_score"), F.count("_score")), 1).alias("avg_satisfaction"), F.count("_score").alias("responses")
    )
    return bands.orderBy("_bin").drop("_bin")


def load_by_status(doctors: DataFrame, facts: DataFrame, key: str, fact_key: str, status: str) -> DataFrame:
    """Stays per doctor by employment status. Doctors without stays are not counted.

    Counting per doctor first makes the distinct count a plain count.
    """
    per_doctor = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    joined = per_doctor.join(doctors.select(key, status), key)
    groups = joined.groupBy(status).agg(F.count(F.lit(1)).alias("doctor_count"), F.sum("n").alias("total_admissions"))
    per = half_up(ratio(F.col("total_admissions"), F.col("doctor_count")), 1)
    return groups.withColumn("admissions_per_doctor", per).orderBy(F.desc("admissions_per_doctor"), status)


def group_table(facts: DataFrame, hops: Sequence[Hop], name: str, stay: Column, flag: Column) -> DataFrame:
    """Count, mean stay and flag rate per group, and whether the rate is above that of all groups together."""
    one = F.lit(1).cast("long")
    parts = {"n": one, "days": stay, "known": F.when(stay.isNotNull(), one), "flags": flag}
    sums = settle(sums_along(facts, hops, [name], parts))  # one row per group: the rows and the total read it
    rate = half_up(percent(F.col("flags"), F.col("n")), 2)
    overall = sums.agg(half_up(percent(F.sum("flags"), F.sum("n")), 2).alias("v")).scalar()
    return sums.select(
        name,
        F.col("n").alias("admissions"),
        half_up(ratio(F.col("days"), F.col("known")), 2).alias("avg_los"),
        rate.alias("readmission_rate_pct"),
        (rate > overall).alias("above_network"),
    ).orderBy(F.desc("admissions"), name)


def count_with_share(df: DataFrame, kind: str, count: str = "admissions") -> DataFrame:
    """Rows per kind and their share of all rows in percent."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias(count))
    total = counts.agg(F.sum(count).alias("v")).scalar()
    share = half_up(percent(F.col(count), total), 1)
    return counts.withColumn("share_pct", share).orderBy(F.desc(count), kind)


def mix_with_unknown(df: DataFrame, kind: str, count: str = "patients", unknown: str = "Unknown") -> DataFrame:
    """Rows per kind, NULL shown as ``unknown``."""
    label = F.coalesce(F.col(kind), F.lit(unknown)).alias(kind)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), kind)


def relative_risk(features: DataFrame, bucket: str, flag: str, exposed: str, baseline: str) -> DataFrame:
    """Flag rates of two buckets in percent and their ratio, from one pass."""
    rates = features.agg(
        mean(F.when(F.col(bucket) == exposed, F.col(flag))).alias("e"),
        mean(F.when(F.col(bucket) == baseline, F.col(flag))).alias("b"),
    )
    return rates.select(
        half_up(F.col("e") * 100, 1).alias("exposed_rate_pct"),
        half_up(F.col("b") * 100, 1).alias("baseline_rate_pct"),
        half_up(ratio(F.col("e"), F.col("b")), 2).alias("relative_risk"),
    )


def gap_pct(features: DataFrame, condition: Column, measure: str) -> DataFrame:
    """Mean of ``measure`` with and without ``condition`` and the gap in percent of the latter."""
    means = features.agg(
        mean(F.when(condition, F.col(measure))).alias("w"), mean(F.when(~condition, F.col(measure))).alias("d")
    )
    return means.select(
        half_up(F.col("d"), 1).alias("weekday_avg"),
        half_up(F.col("w"), 1).alias("weekend_avg"),
        half_up(percent(F.col("w") - F.col("d"), F.col("d")), 2).alias("gap_pct"),
    )


# --- outliers ---------------------------------------------------------------------------------------------


def group_outliers(
    facts: DataFrame, group: str, measure: str, columns: Sequence[str], deviations: float = 3.0
) -> DataFrame:
    """Rows above mean + ``deviations`` standard deviations of their group, with the z-score.

    The statistics are taken first and looked up by each fact, so the facts themselves are not shuffled.
    """
    stats = facts.groupBy(group).agg(F.avg(measure).alias("_avg"), F.stddev_samp(measure).alias("_std"))
    joined = join_lookup(facts, settle(stats), group)
    bound = F.col("_avg") + F.lit(float(deviations)) * F.col("_std")
    return joined.where(F.col(measure) > bound).select(
        *columns, half_up(z_score(F.col(measure), F.col("_avg"), F.col("_std")), 2).alias("z_score")
    )


def outlier_summary(outliers: DataFrame, group: str) -> DataFrame:
    """One row: number of outliers and the group with most of them (the first by name on a tie)."""
    per_group = outliers.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(-F.col("n"), F.col(group))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_outliers"), F.min_by(group, rank).alias("top_group")
    )
