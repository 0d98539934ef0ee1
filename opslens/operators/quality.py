"""Profiling, data-quality checks and validation rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, percent
from opslens.operators.joins import join_equal, orphan_counts, settle
from opslens.operators.quantiles import TASK_ROWS, group_quantiles
from opslens.session import stored


# --- duplicates -------------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with ``occurrences``."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def duplicate_members(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once. NULLs in a key count as equal."""
    return join_equal(df, stored(duplicate_keys(df, key).select(*key)), key, "left_semi")


def surplus_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: all rows, rows beyond the first per key, and their share in percent."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rows, removed = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return per_key.agg(
        rows.alias("total_rows"), removed.alias("surplus_rows"), half_up(percent(removed, rows), 2).alias("surplus_pct")
    )


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


# --- profiling --------------------------------------------------------------------------------------------


def schema_info(df: DataFrame) -> DataFrame:
    """Column name, type and non-NULL count, from one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "field", "n_non_null")
    chain = None
    for name, dtype in df.dtypes:
        test = F.col("field") == name
        chain = F.when(test, dtype) if chain is None else chain.when(test, dtype)
    return counts.select("field", chain.alias("dtype"), "n_non_null")


def null_counts(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """NULL count per column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "field", "n_null")
    return long.where(F.col("n_null") > 0) if only_missing else long


def missing_fields(df: DataFrame, fields: Sequence[str], total: str = "total_rows") -> DataFrame:
    """One row: ``missing_<field>`` counts and the row count."""
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in fields], F.count(F.lit(1)).alias(total)
    )


def describe(df: DataFrame, fields: Sequence[str], digits: int = 2, task_rows: int = TASK_ROWS) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric field; the fields share a pass for all but the quartiles."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in fields])
    basics = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = wide.agg(
        *[F.struct(F.lit(c).alias("field"), *[of(c).alias(name) for name, of in basics.items()]).alias(c) for c in fields]
    )
    basic = settle(row.select(F.explode(F.array(*fields)).alias("s")).select("s.*"))
    points = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if (basic.agg(F.max("n")).first()[0] or 0) <= task_rows:
        # few enough values for one aggregate: a row of quartiles for each field, and no row per value
        picked = [F.struct(F.lit(c).alias("field"), F.percentile(c, list(points.values())).alias("q")).alias(c) for c in fields]
        each = wide.agg(*picked).select(F.explode(F.array(*fields)).alias("s")).select("s.*")
        quartiles = each.select("field", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(points)])
    else:
        long = wide.unpivot([], list(fields), "field", "value")
        quartiles = group_quantiles(long, ["field"], "value", points, sizes=basic, task_rows=task_rows)
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return basic.join(quartiles, "field", "left").select(
        "field", "n", *[half_up(F.col(c), digits).alias(c) for c in numbers]
    )


def value_counts(df: DataFrame, field: str, dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first."""
    rows = df.where(F.col(field).isNotNull()) if dropna else df
    counts = rows.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(field))


def value_shares(df: DataFrame, field: str, digits: int = 4, dropna: bool = True) -> DataFrame:
    """Share of each value in all counted rows."""
    rows = df.where(F.col(field).isNotNull()) if dropna else df
    counts = rows.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(field, half_up(percent(F.col("n"), total) / 100, digits).alias("share"))


def bad_share(df: DataFrame, bad: Column) -> DataFrame:
    """One row: rows that satisfy ``bad`` and their percentage."""
    n = F.count_if(bad)
    return df.agg(n.alias("n_bad"), half_up(percent(n, F.count(F.lit(1))), 2).alias("bad_pct"))


# --- raw checks -------------------------------------------------------------------------------------------


def non_positive_rows(df: DataFrame, measure: str, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(measure) <= 0).select(*columns)


def label_variants(df: DataFrame, label: str) -> DataFrame:
    """Distinct spellings of a raw label, in order."""
    return df.select(label).distinct().orderBy(label)


def orphan_rows(children: DataFrame, foreign_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (or is NULL).

    The keys without a parent are found first, from one row per key, and looked up by the child rows.
    """
    lost = orphan_counts(children, foreign_key, parents, parent_key).select(F.col("key").alias(foreign_key))
    return join_equal(children, stored(lost), [foreign_key], "left_semi")


# --- validation rules: frames (rule, violations, passed) --------------------------------------------------


def rule_result(frame: DataFrame, rule: str, violations: Column) -> DataFrame:
    found = F.coalesce(violations.cast("long"), F.lit(0).cast("long"))
    return frame.agg(found.alias("violations")).select(
        F.lit(rule).alias("rule"), "violations", (F.col("violations") == 0).alias("passed")
    )


def row_rules(
    df: DataFrame, rules: dict[str, Column], null_passes: bool = False, domains: dict[str, tuple[str, Sequence]] | None = None
) -> DataFrame:
    """Rows that break each rule, all rules from one pass.

    A test that comes out NULL breaks the rule, or passes as in a SQL CHECK with ``null_passes``. ``domains`` (rule ->
    field and allowed values) adds rules that count distinct non-NULL values outside a list, in the same pass.
    """
    domains = domains or {}
    counts = df.agg(
        *[F.count_if(~F.coalesce(test, F.lit(null_passes))).alias(name) for name, test in rules.items()],
        *[F.count_distinct(F.when(~F.col(f).isin(*allowed), F.col(f))).alias(name) for name, (f, allowed) in domains.items()],
    )
    long = counts.unpivot([], [*rules, *domains], "rule", "violations")
    return long.withColumn("passed", F.col("violations") == 0)


def unique_rule(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Rows beyond the first per key value."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return rule_result(per_key, rule, F.sum(F.col("n") - 1))


def domain_rule(df: DataFrame, field: str, allowed: Sequence, rule: str) -> DataFrame:
    """Distinct non-NULL values outside the allowed list."""
    distinct = df.where(F.col(field).isNotNull()).select(field).distinct()
    return rule_result(distinct, rule, F.count_if(~F.col(field).isin(*allowed)))


def foreign_key_rule(children: DataFrame, foreign_key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Child rows without a parent; a NULL key counts as one."""
    return rule_result(orphan_counts(children, foreign_key, parents, parent_key), rule, F.sum("n_rows"))


def all_rules(*results: DataFrame) -> DataFrame:
    out = results[0]
    for result in results[1:]:
        out = out.unionByName(result)
    return out


def require(results: DataFrame) -> None:
    """Raise when any rule is broken. The table has one row per rule."""
    broken = results.where(~F.col("passed")).collect()
    if broken:
        raise AssertionError("; ".join(f"{r['rule']}: {r['violations']} violations" for r in broken))


# --- reconciliation ---------------------------------------------------------------------------------------


def reconcile_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row that compares two copies: row counts, keys found on one side only, keys with unequal counts."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
        (F.count_if(F.col("l") != F.col("r")) == 0).alias("matches"),
    )


def reconcile_metrics(left: DataFrame, right: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Compare two one-row frames metric by metric."""

    def long(frame: DataFrame, value: str) -> DataFrame:
        return frame.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", value)

    both = long(left, "left_value").join(long(right, "right_value"), "metric", "full")
    return both.withColumn("agrees", F.col("left_value").eqNullSafe(F.col("right_value")))
