"""Running totals and row numbers over sets of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.joins import join_lookup, settle
from opslens.session import stored


def running_totals(df: DataFrame, order: Column, totals: dict[str, str]) -> DataFrame:
    """Add inclusive running sums (``totals``: new column -> summed column) in ``order``, which must be unique.

    A window without a partition would sort everything in one task. Here the rows are range-partitioned, each
    partition runs its own window, and the sums of the partitions before it are added. The partitioned rows are
    stored with their partition number, so it stays the same whenever a lost task is run again.
    """
    parts = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in totals.items()])
    # One row per partition of the shuffle above: bounded by spark.sql.shuffle.partitions.
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in totals]
    )
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_lookup(parts, settle(offsets), "_part")
    return joined.select(
        *df.columns, *[(F.sum(c).over(within) + F.col(f"_before_{name}")).alias(name) for name, c in totals.items()]
    )


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Number the rows of each group from 1 on, in no particular but a fixed order.

    Each partition numbers its own rows, after those of the group in the partitions before it.
    """
    fixed = stored(df.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = fixed.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_id"))
    joined = join_lookup(fixed, settle(offsets), [by, "_part"])
    return joined.withColumn(name, within + F.col("_before")).select(*df.columns, name)
