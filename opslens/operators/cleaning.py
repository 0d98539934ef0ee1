"""Repair steps: de-duplicate, impute, canonicalise, clip. Their order matters to the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.scalar import clamp, outside
from opslens.operators.joins import join_lookup, settle
from opslens.operators.quantiles import TASK_ROWS, group_quantiles


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key under ``order``.

    Spark limits each key to one row per task before the shuffle (WindowGroupLimit), so a key with many copies
    does not end up whole in one task.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def impute_group_median(df: DataFrame, group: str, measure: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Replace non-positive values by the median of the positive ones in the group.

    A group without a positive value gives NULL. NULL values are left as they are.
    """
    valid = df.where(F.col(measure) > 0)
    medians = settle(group_quantiles(valid, [group], measure, {"_median": 0.5}, task_rows=task_rows))
    joined = join_lookup(df, medians, group, "left")
    repaired = F.when(F.col(measure) <= 0, F.col("_median")).otherwise(F.col(measure).cast("double"))
    return joined.withColumn(measure, repaired).select(*df.columns)


def canonical_label(df: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """Add the canonical label of the key; NULL when the key is unknown."""
    return join_lookup(df, labels.select(key, label), key, "left")


def split_audit(df: DataFrame, raw: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The frame without its raw label, and the audit columns beside the raw label."""
    return df.drop(raw), df.select(*columns, raw)


def iqr_bounds(df: DataFrame, fields: Sequence[str], k: float = 3.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Fences q1 - k * iqr and q3 + k * iqr: rows (field, low, high)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in fields]).unpivot([], list(fields), "field", "value")
    quartiles = group_quantiles(long, ["field"], "value", {"q1": 0.25, "q3": 0.75}, task_rows=task_rows)
    reach = (F.col("q3") - F.col("q1")) * F.lit(float(k))
    return quartiles.select("field", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def fences(bounds: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Fences as literals, so that the clip is a plain projection: one row per field reaches the driver."""
    return {r["field"]: (F.lit(r["low"]), F.lit(r["high"])) for r in bounds.collect()}


def iqr_clip(df: DataFrame, fields: Sequence[str], k: float = 3.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Clip each field to its fences; all fences are taken from the unclipped frame."""
    found = fences(iqr_bounds(df, fields, k, task_rows))
    return df.withColumns({c: clamp(F.col(c).cast("double"), *found[c]) for c in fields if c in found})


def clip_counts(df: DataFrame, fields: Sequence[str], k: float = 3.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Fences and the number of values outside them: (field, low, high, n_clipped)."""
    bounds = settle(iqr_bounds(df, fields, k, task_rows))
    found = fences(bounds)
    counts = df.agg(*[F.count_if(outside(F.col(c), *found[c])).alias(c) for c in fields if c in found])
    return bounds.join(counts.unpivot([], list(found), "field", "n_clipped"), "field")
