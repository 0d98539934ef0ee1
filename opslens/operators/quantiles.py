"""Exact order statistics and quantiles per group, without gathering a large group in one task.

Groups of up to ``task_rows`` rows are handled by Spark's ``percentile`` (or a sort per group). For a larger
group, a quantile sketch proposes cut points, one pass counts the rows between them exactly, and only the cell
that holds the wanted rank is looked into again. The sketch steers the search and never decides a result: ranks
come from exact counts. ``task_rows`` decides the way alone: both give the same bits. Each pass shrinks a cell to about 1/64 of it (the first one much further around the
wanted probabilities), so 10^12 rows need three or four passes, none of which shuffles more than per-cell counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.joins import join_lookup, settle

TASK_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
GRID = [i / 64 for i in range(65)]  # cut points of the later passes
SLOTS = 2 * len(GRID) + 1  # numbers a cell within the one before it; a long holds nine passes


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    *,
    sizes: DataFrame | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per group with an interpolated quantile column per entry of ``quantiles``; NULLs are ignored.

    A NULL group key forms a group of its own. With no ``by`` columns the result is one row. ``sizes(by.., n)``
    may give the number of known values per group; it is counted otherwise.
    """
    by = list(by)
    number = F.col(value).cast("double")
    unsigned_zero = F.when(number == 0, F.lit(0.0)).otherwise(number)  # -0.0 and 0.0 are one value
    rows = df.select(*by, unsigned_zero.alias("_v")).where(F.col("_v").isNotNull())
    if sizes is None:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large = settle(sizes.select(*by, "n").where(F.col("n") > task_rows))
    if large.isEmpty():
        return _direct_quantiles(rows, by, quantiles)
    # One struct key from here on: unlike plain columns, structs with NULL fields join as equal.
    rows = rows.select(_group_key(by), *by, "_v")
    large = large.select(_group_key(by), "n")
    found = _searched_quantiles(join_lookup(rows, large, "_group", "left_semi"), large, quantiles, task_rows)
    if not by:
        return found.drop("_group")
    found = found.select("_group.*", *quantiles)
    small = join_lookup(rows, large, "_group", "left_anti")
    return _direct_quantiles(small, by, quantiles).unionByName(found)


def _group_key(by: Sequence[str]) -> Column:
    return (F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).alias("_group")


def _direct_quantiles(rows: DataFrame, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    probabilities = F.array(*[F.lit(float(p)) for p in quantiles.values()])
    found = rows.groupBy(*by).agg(F.percentile("_v", probabilities).alias("_q"))
    return found.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)])


def _searched_quantiles(rows: DataFrame, sizes: DataFrame, quantiles: dict[str, float], task_rows: int) -> DataFrame:
    """Quantiles of the groups in ``sizes(_group, n)`` from the two ranks around each position."""
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in quantiles.items()]
    )
    place = (F.col("n") - 1) * F.col("w.p")
    targets = settle(
        sizes.withColumn("w", F.explode(wanted))
        .select("_group", F.col("w.name").alias("name"), place.alias("place"))
        .withColumn("k", F.explode(F.array(F.floor("place"), F.ceil("place"))))
    )
    found = select_ranks(
        rows, "_v", targets.select("_group", "k").distinct(),
        probabilities=list(quantiles.values()), largest=sizes.agg(F.max("n")).first()[0], task_rows=task_rows,
    )
    values = join_lookup(targets, settle(found.select("_group", "k", "value")), ["_group", "k"])
    # The same formula as Spark's percentile, so that a value does not depend on the way it was found.
    low, high, at = F.min("value"), F.max("value"), F.max("place")
    between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
    points = values.groupBy("_group", "name").agg(F.when(low == high, low).otherwise(between).alias("q"))
    return points.groupBy("_group").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in quantiles])


def select_ranks(
    rows: DataFrame,
    value: str,
    targets: DataFrame,
    *,
    probabilities: Sequence[float] = (),
    largest: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Values at 0-based ranks: ``rows(_group, value)``, ``targets(_group, k)`` ->
    ``(_group, k, value, below, equal)`` with the number of rows below and equal to the value.

    ``rows`` must hold no NULL value. ``probabilities`` tells where the ranks lie, to search closely there first;
    ``largest`` is the size of the largest group, when known.
    """
    live = rows.select("_group", F.col(value).alias("_v"), F.lit(0).cast("long").alias("_cell"))
    unsolved = targets.select(
        "_group", "k", F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_before")
    )
    solved = None
    grid = _grid_around(probabilities) if probabilities else GRID
    cell = ["_group", "_cell"]
    previous = None
    if largest is None:
        largest = _largest(live.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")))
    while largest > task_rows and (previous is None or largest < previous):
        sketch = settle(live.groupBy(*cell).agg(F.percentile_approx("_v", grid, SKETCH_ACCURACY).alias("_edges")))
        previous = largest
        slotted = join_lookup(live, sketch, cell).select(*cell, "_v", _slot(len(grid)).alias("_slot"))
        histogram = settle(
            slotted.groupBy(*cell, "_slot").agg(
                F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
            )
        )
        earlier = Window.partitionBy(*cell).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        hits = settle(
            join_lookup(histogram, unsolved.select(*cell, "_before").distinct(), cell)
            .withColumn("_start", start)
            .join(unsolved.drop("_before"), cell)
            .where((F.col("k") >= F.col("_start")) & (F.col("k") < F.col("_start") + F.col("_n")))
        )
        exact = hits.where(F.col("_min") == F.col("_max")).select(
            "_group", "k", F.col("_min").alias("value"), F.col("_start").alias("below"), F.col("_n").alias("equal")
        )
        solved = exact if solved is None else solved.unionByName(exact)
        inner = (F.col("_cell") * SLOTS + F.col("_slot")).alias("_cell")
        hits = hits.where(F.col("_min") != F.col("_max"))
        largest = _largest(hits)
        unsolved = hits.select("_group", "k", inner, F.col("_start").alias("_before"))
        wanted = settle(unsolved.select(*cell).distinct())
        live = join_lookup(slotted.select("_group", "_v", inner), wanted, cell, "left_semi")
        grid = GRID
    upto = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = live.groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    rank = F.col("k") - F.col("_before")
    rest = (
        ranked.join(settle(unsolved), cell)
        .where((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")))
        .select(
            "_group", "k", F.col("_v").alias("value"),
            (F.col("_before") + F.col("_upto") - F.col("_n")).alias("below"), F.col("_n").alias("equal"),
        )
    )
    return rest if solved is None else rest.unionByName(solved)


def _largest(sizes: DataFrame) -> int:
    return sizes.agg(F.max("_n")).first()[0] or 0


def _grid_around(probabilities: Sequence[float]) -> list[float]:
    """Cut points just outside the sketch error on both sides of each wanted probability."""
    slack = 3.0 / SKETCH_ACCURACY
    near = {min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-slack, slack)}
    return [float(p) for p in sorted(near | {0.0, 1.0})]


def _slot(cuts: int) -> Column:
    """Slot of ``_v`` among the ascending cut points: odd slots equal one, even slots lie strictly between two."""
    slot = F.lit(0)
    for i in range(cuts):
        edge = F.col("_edges")[i]
        slot = slot + F.when(F.col("_v") > edge, 2).when(F.col("_v") == edge, 1).otherwise(0)
    return slot
