"""Monthly and daily series. Windows here run over one row per month, after the aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, month_label, month_start, ratio
from opslens.operators.joins import settle
from opslens.session import stored


def monthly_counts(facts: DataFrame, date: str) -> DataFrame:
    """Rows per month that has any."""
    month = month_start(F.col(date)).alias("month")
    return facts.where(F.col(date).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("admissions"))


def monthly_trend(facts: DataFrame, date: str, periods: int = 3, min_periods: int = 1) -> DataFrame:
    """Monthly volume, change against the previous row, and the mean of the last ``periods`` rows.

    The mean is NULL until ``min_periods`` rows are there.
    """
    return trend_of_counts(monthly_counts(facts, date), periods, min_periods)


def trend_of_counts(counts: DataFrame, periods: int = 3, min_periods: int = 1) -> DataFrame:
    """``monthly_trend`` of the rows per month."""
    order = Window.orderBy("month")
    last = order.rowsBetween(1 - periods, Window.currentRow)
    average = F.when(F.count(F.lit(1)).over(last) >= min_periods, half_up(F.avg("admissions").over(last), 1))
    return counts.select(
        F.col("month").alias("admission_month"),
        F.col("admissions").alias("admissions_count"),
        (F.col("admissions") - F.lag("admissions").over(order)).alias("mom_change"),
        average.alias("moving_avg_3m"),
    ).orderBy("admission_month")


def last_rows(series: DataFrame, order: str, n: int) -> DataFrame:
    """Last ``n`` rows of an ordered series, in ascending order."""
    return series.orderBy(F.desc(order)).limit(n).orderBy(order)


def month_labels(facts: DataFrame, date: str) -> DataFrame:
    """Rows per ``yyyy-MM`` label."""
    label = month_label(F.col(date)).alias("month")
    return facts.groupBy(label).agg(F.count(F.lit(1)).alias("admissions")).orderBy("month")


def month_calendar(months: DataFrame, month: str = "month") -> DataFrame:
    """Every month from the first to the last of ``months``."""
    span = months.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    return span.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )


def gap_filled_months(facts: DataFrame, date: str) -> DataFrame:
    """Monthly volume with a 0 for each month without rows."""
    counts = monthly_counts(facts, date)
    filled = month_calendar(counts).join(counts, "month", "left")
    return filled.select("month", F.coalesce("admissions", F.lit(0)).alias("admissions")).orderBy("month")


def calendar_shift_change(facts: DataFrame, date: str, months: int = 1) -> DataFrame:
    """Volume per month against the calendar month before; a blank month counts as 0."""
    counts = gap_filled_months(facts, date)
    prior = counts.select(F.add_months("month", months).alias("month"), F.col("admissions").alias("prior_month"))
    joined = counts.join(prior, "month", "left")
    change = F.col("admissions") - F.coalesce(F.col("prior_month"), F.lit(0))
    return joined.withColumn("mom_change", change).orderBy("month")


def trailing_daily_mean(facts: DataFrame, date: str, months: int = 3) -> DataFrame:
    """Mean of the daily totals over the trailing calendar months; days without rows are skipped."""
    day = F.col(date).cast("date")
    daily = facts.where(day.isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    monthly = daily.groupBy(month_start(F.col("day")).alias("month")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("days")
    )
    last = Window.orderBy("month").rowsBetween(1 - months, Window.currentRow)
    filled = month_calendar(monthly).join(monthly, "month", "left")
    average = ratio(F.sum("n").over(last), F.sum("days").over(last))
    return filled.select("month", half_up(average, 4).alias("moving_avg_daily")).orderBy("month")


def calendar_table(facts: DataFrame, date: str) -> DataFrame:
    """One row per day from the first to the last date of the facts."""
    day = F.col(date).cast("date")
    span = facts.agg(F.min(day).alias("a"), F.max(day).alias("b")).where(F.col("a").isNotNull())
    return calendar_days(span)


def calendar_days(span: DataFrame) -> DataFrame:
    """Days of a one-row frame (a, b), with the parts a date table is sliced by."""
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    date = F.col("date")
    return days.select(
        "date", F.year(date).alias("year"), F.month(date).alias("month"), (F.weekday(date) >= 5).alias("is_weekend")
    )


# --- a series kept up to date from load to load -----------------------------------------------------------


def add_load(state: str, facts: DataFrame, date: str, load: str) -> DataFrame:
    """Adds the rows of a load to the monthly state in the folder ``state``, and returns the months it has changed.

    The state has one row per month and load, partitioned by month. A load writes only the partitions of its months,
    whose other rows are read and written with it; a load that is run again replaces what it added before, so a rerun
    after a failure counts nothing twice. Its months are those of the rows it has now and of those it had.
    """
    spark = facts.sparkSession
    new = monthly_counts(facts, date).select(
        F.lit(load).alias("load"), F.col("admissions").alias("n_rows"), F.date_format("month", "yyyy-MM-dd").alias("month")
    )
    before = read_state(spark, state)
    if before is None:
        changed = stored(new)
        kept = changed.limit(0)
    else:
        new = stored(new)
        months = stored(new.select("month").unionByName(before.where(F.col("load") == load).select("month")).distinct())
        others = before.where(F.col("load") != load)
        kept = stored(others.join(F.broadcast(settle(months)), "month", "left_semi").select("load", "n_rows", "month"))
        # a month that the load has left keeps a row, so that its partition is written anew
        gone = months.join(new.select("month"), "month", "left_anti").select(F.lit(load).alias("load"), F.lit(0).cast("long").alias("n_rows"), "month")
        changed = new.unionByName(gone)
    written = stored(kept.unionByName(changed))
    written.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(state)
    return written.select("month").distinct()


def read_state(spark: SparkSession, state: str) -> DataFrame | None:
    """``load, n_rows, month`` of the monthly state; None before the first load."""
    place = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("load string, n_rows long, month string").parquet(state)


def trend_of_state(spark: SparkSession, state: str, periods: int = 3, min_periods: int = 1) -> DataFrame:
    """The monthly trend from the state alone: one row per month and load is read, and no fact."""
    months = read_state(spark, state).groupBy(F.to_date("month").alias("month")).agg(F.sum("n_rows").alias("admissions"))
    return trend_of_counts(months.where("admissions > 0"), periods, min_periods)
