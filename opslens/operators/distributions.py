"""Chart tables: box summaries, bucket rates, row-percent mixes, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import bin_index, bin_label, half_up, mean, percent
from opslens.operators.joins import join_lookup, settle
from opslens.operators.kpis import means_by_wait, score_by_wait_cut
from opslens.operators.quantiles import TASK_ROWS, group_quantiles

# Wait bands of the chart, which leave out a wait of 0.
CHART_WAIT_EDGES = [0, 15, 30, 60, 10000]
CHART_WAIT_LABELS = ["<15", "15-30", "30-60", "60+"]


def box_summary(df: DataFrame, group: str, measure: str, digits: int = 4, task_rows: int = TASK_ROWS) -> DataFrame:
    """Box-plot figures per group, highest median first.

    Whiskers are the outermost data points within 1.5 iqr of the box; points beyond them are outliers. The
    quartiles are looked up by the rows, so the second pass shuffles only per-group partial results.
    """
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = settle(group_quantiles(df, [group], measure, points, task_rows=task_rows))
    rows = join_lookup(df.select(group, F.col(measure).cast("double").alias("v")), quartiles, group)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    boxes = rows.groupBy(group, *points).agg(
        F.count("v").alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    figures = ["whisker_low", "q1", "median", "q3", "whisker_high"]
    return boxes.select(
        group, "n", *[half_up(F.col(c), digits).alias(c) for c in figures], "n_outliers"
    ).orderBy(F.desc("median"), group)


def rate_by_bucket(
    df: DataFrame, score: str, flag: str, edges: Sequence[float], labels: Sequence[str], name: str = "bucket"
) -> DataFrame:
    """Mean flag in percent per right-closed bin."""
    value = F.col(score)
    binned = df.select(bin_index(value, edges).alias("_bin"), bin_label(value, edges, labels).alias(name), flag)
    rates = binned.where(F.col("_bin").isNotNull()).groupBy("_bin", name).agg(
        half_up(mean(F.col(flag)) * 100, 4).alias("rate_pct")
    )
    return rates.orderBy("_bin").drop("_bin")


def band_means(surveys: DataFrame, stays: DataFrame, key: str, score: str, wait: str) -> DataFrame:
    """Mean survey score per chart wait band; unanswered surveys are dropped."""
    answered = surveys.dropna(subset=[score])
    return score_by_wait_cut(answered, stays, key, score, wait, CHART_WAIT_EDGES, CHART_WAIT_LABELS)


def band_means_of(stays: DataFrame, score: str, wait: str) -> DataFrame:
    """The same means where each row holds both the score and the wait, as in the feature table: one pass."""
    return means_by_wait(stays.dropna(subset=[score]), F.col(score), F.col(wait), CHART_WAIT_EDGES, CHART_WAIT_LABELS)


def mix_table(df: DataFrame, group: str, kind: str, values: Sequence, digits: int = 4) -> DataFrame:
    """Row-percent cross table: one column for each of the given kinds, each row adding up to 100.

    Rows of other kinds are left out; ``mix_long`` takes any number of kinds as they come.
    """
    values = list(values)
    known = df.where(F.col(kind).isin(*values) & F.col(group).isNotNull())
    counts = known.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(kind) == v).alias(str(v)) for v in values]
    )
    return counts.select(
        group, *[half_up(percent(F.col(f"`{v}`"), F.col("_n")), digits).alias(str(v)) for v in values]
    ).orderBy(group)


def mix_long(df: DataFrame, group: str, kind: str, digits: int = 4) -> DataFrame:
    """The same shares as rows (group, kind, share_pct), for any number of kinds; absent pairs have no row."""
    known = df.where(F.col(kind).isNotNull() & F.col(group).isNotNull())
    counts = known.groupBy(group, kind).agg(F.count(F.lit(1)).alias("_n"))
    totals = settle(counts.groupBy(group).agg(F.sum("_n").alias("_total")))
    shares = join_lookup(counts, totals, group)
    return shares.select(group, kind, half_up(percent(F.col("_n"), F.col("_total")), digits).alias("share_pct"))


def correlations(df: DataFrame, fields: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of all field pairs over the rows where both are known: (field_a, field_b, corr).

    NULL for a constant field. The co-moments of all pairs are one aggregate, which merges: a task keeps one row of them,
    and one row for each task leaves it.
    """
    row = df.select(*[F.col(c).cast("double").alias(c) for c in fields])
    cells = {}
    for i, a in enumerate(fields):
        cells[i, i] = F.when(F.var_samp(a) > 0, F.lit(1.0))
        for j in range(i + 1, len(fields)):
            both = F.col(a).isNotNull() & F.col(fields[j]).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(fields[j]))
            cells[i, j] = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    moments = row.agg(*[half_up(c, digits).alias(f"{i}_{j}") for (i, j), c in cells.items()])
    mirrored = {f"{j}_{i}": F.col(f"{i}_{j}") for i, j in cells if i != j}
    every = moments.withColumns(mirrored) if mirrored else moments
    names, places = F.array(*map(F.lit, fields)), F.split("cell", "_")
    long = every.unpivot([], every.columns, "cell", "corr")
    return long.select(F.get(names, places[0].cast("int")).alias("field_a"), F.get(names, places[1].cast("int")).alias("field_b"), "corr")
