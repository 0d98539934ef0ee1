"""Dashboard measures as aggregate columns; a filter context becomes the ``by`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, mean, percent, ratio
from opslens.operators.features import EFFICIENCY_LABELS

RUSHED, EXCELLENT = EFFICIENCY_LABELS[0], EFFICIENCY_LABELS[-1]


def rate_measure(flag: str, context: Column | None = None) -> Column:
    """Flagged rows over all rows in percent, within an optional filter."""
    inside = F.lit(True) if context is None else F.coalesce(context, F.lit(False))
    return percent(F.count_if(inside & (F.col(flag) == 1)), F.count_if(inside))


def definitions(
    stay: str = "length_of_stay_days", wait: str = "wait_minutes", score: str = "satisfaction_score",
    flag: str = "readmitted_30d", bucket: str = "discharge_efficiency_bucket", gross: str = "gross_charge",
    margin: str = "margin",
) -> dict[str, Column]:
    """The measures that are plain aggregates of the feature table. Margin is a fraction, rates are percent."""
    rushed = rate_measure(flag, F.col(bucket) == RUSHED)
    excellent = rate_measure(flag, F.col(bucket) == EXCELLENT)
    return {
        "total_admissions": F.count(F.lit(1)),
        "avg_length_of_stay": mean(F.col(stay)),
        "avg_triage_wait": mean(F.col(wait)),
        "avg_satisfaction": mean(F.col(score)),
        "gross_billings": F.sum(gross),
        "readmission_rate_pct": rate_measure(flag),
        "gross_margin": F.sum(margin),
        "margin_fraction": ratio(F.sum(margin), F.sum(gross)),
        "rushed_rate_pct": rushed,
        "excellent_rate_pct": excellent,
        "relative_risk": ratio(rushed, excellent),
    }


def measures(
    features: DataFrame, names: Sequence[str], by: Sequence[str] = (), digits: int = 6, **columns: str
) -> DataFrame:
    """The named measures per ``by`` group, or one row for all stays."""
    known = definitions(**columns)
    picked = [
        known[n].alias(n) if n == "total_admissions" else half_up(known[n], digits).alias(n) for n in names
    ]
    return features.groupBy(*by).agg(*picked)
