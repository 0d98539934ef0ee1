"""Feature table of the stays: calendar, age, child totals, finance, survey score, bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import age_years, bin_label, half_up, in_months, is_weekend, percent, ratio
from opslens.operators.joins import join_lookup

# Bin edges and labels of the published results.
AGE_EDGES = [0, 18, 35, 50, 65, 120]
AGE_LABELS = ["0-18", "19-35", "36-50", "51-65", "66+"]
EFFICIENCY_EDGES = [0, 40, 60, 80, 100]
EFFICIENCY_LABELS = ["Rushed (0-40)", "Below Avg (40-60)", "Good (60-80)", "Excellent (80-100)"]
FLU_MONTHS = [12, 1, 2]
FEATURE_COLUMNS = [
    "admission_id", "patient_id", "department_id", "department", "admission_type", "severity_score",
    "length_of_stay_days", "wait_minutes", "discharge_efficiency", "discharge_efficiency_bucket", "readmitted_30d",
    "patient_age", "age_group", "is_weekend_admission", "admission_month", "is_flu_season", "treatment_count",
    "total_treatment_cost", "gross_charge", "margin", "cost_per_stay_day", "satisfaction_score",
]


def add_age(stays: DataFrame, people: DataFrame, key: str, birth: str, date: str) -> DataFrame:
    """Age at the event and its band. The person of a stay may be a hot key, so this is a lookup join."""
    joined = join_lookup(stays, people.select(key, birth), key, "left")
    aged = joined.withColumn("patient_age", age_years(F.col(date), F.col(birth)))
    return aged.withColumn("age_group", bin_label(F.col("patient_age"), AGE_EDGES, AGE_LABELS)).drop(birth)


def add_calendar(stays: DataFrame, date: str, season: Sequence[int] = FLU_MONTHS) -> DataFrame:
    day = F.col(date)
    return stays.withColumns(
        {
            "is_weekend_admission": is_weekend(day),
            "admission_month": F.month(day),
            "is_flu_season": in_months(day, season),
        }
    )


def add_children(stays: DataFrame, children: DataFrame, key: str, child: str, cost: str) -> DataFrame:
    """Child count and total cost, 0 where there are none. Children are summed per stay before the join."""
    totals = children.groupBy(key).agg(
        F.count(child).alias("treatment_count"), F.sum(cost).alias("total_treatment_cost")
    )
    joined = stays.join(totals, key, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("treatment_count", "total_treatment_cost")}
    )


def add_finance(stays: DataFrame, billing: DataFrame, key: str, gross: str, cost: str, stay: str) -> DataFrame:
    """Gross charge, margin, and charge per day of stay (NULL when the stay is 0 days)."""
    slim = billing.select(key, F.col(gross).alias("gross_charge"), (F.col(gross) - F.col(cost)).alias("margin"))
    joined = stays.join(slim, key, "left")
    return joined.withColumn("cost_per_stay_day", half_up(ratio(F.col("gross_charge"), F.col(stay)), 2))


def add_survey(stays: DataFrame, surveys: DataFrame, key: str, score: str) -> DataFrame:
    """Survey score; NULL where nobody answered."""
    return stays.join(surveys.select(key, F.col(score).alias("satisfaction_score")), key, "left")


def response_rate(df: DataFrame, score: str) -> DataFrame:
    """One row: answered rows in percent of all rows."""
    return df.agg(half_up(percent(F.count(score), F.count(F.lit(1))), 1).alias("response_rate_pct"))


def add_bucket(stays: DataFrame, score: str) -> DataFrame:
    bucket = bin_label(F.col(score), EFFICIENCY_EDGES, EFFICIENCY_LABELS)
    return stays.withColumn("discharge_efficiency_bucket", bucket)


def feature_table(
    admissions: DataFrame, patients: DataFrame, treatments: DataFrame, billing: DataFrame, surveys: DataFrame
) -> DataFrame:
    """All features of the cleaned stays, with the stay's date added for calendar measures.

    The lookup join comes first; the joins after it are all on the stay id and share one shuffle of the stays.
    """
    frame = add_age(admissions, patients, "patient_id", "date_of_birth", "admission_date")
    frame = add_calendar(frame, "admission_date")
    frame = add_bucket(frame, "discharge_efficiency")
    frame = add_children(frame, treatments, "admission_id", "treatment_id", "treatment_cost")
    frame = add_finance(frame, billing, "admission_id", "gross_charge", "direct_operating_cost", "length_of_stay_days")
    frame = add_survey(frame, surveys, "admission_id", "satisfaction_score")
    return frame.select(*FEATURE_COLUMNS, "admission_date")
