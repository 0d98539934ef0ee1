"""Dashboard measures over every subset of the slicers, from one pass over the facts.

* A measure is kept as partial sums that add up (``Parts``), and its figure is formed after the last sum.
* Distinct counts do not add up, so their state is a set. The facts are reduced to one row per full slice and key, the
  keys of a slice become bitmaps (32,768 keys in 4 KB), and these are united slice by slice.
* Each round sums what the round before it left: facts to keys, keys to bitmaps, bitmaps to slices, slices to figures.
  The facts are scanned once, and are expanded by the number of distinct counts, not by the number of subsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, percent, ratio
from opslens.operators.measures import EXCELLENT, RUSHED


@dataclass(frozen=True)
class Parts:
    """Aggregates that add up over disjoint sets of rows, and the figure formed from their sums by name."""

    sums: dict[str, Column]
    figure: Column
    digits: int | None = 6


def parts(
    stay: str = "length_of_stay_days", wait: str = "wait_minutes", score: str = "satisfaction_score",
    flag: str = "readmitted_30d", bucket: str = "discharge_efficiency_bucket", gross: str = "gross_charge",
    margin: str = "margin",
) -> dict[str, Parts]:
    """The dashboard measures as sums. Their names and figures are those of ``measures.definitions``."""

    def average(name: str, column: str) -> Parts:
        return Parts({f"{name}_sum": F.sum(column), f"{name}_known": F.count(column)}, ratio(F.col(f"{name}_sum"), F.col(f"{name}_known")))

    def rate(name: str, context: Column) -> Parts:
        inside = F.coalesce(context, F.lit(False))
        hits, rows = F.count_if(inside & (F.col(flag) == 1)), F.count_if(inside)
        return Parts({f"{name}_hits": hits, f"{name}_rows": rows}, percent(F.col(f"{name}_hits"), F.col(f"{name}_rows")))

    rushed, excellent = rate("rushed", F.col(bucket) == RUSHED), rate("excellent", F.col(bucket) == EXCELLENT)
    money = {"gross_sum": F.sum(gross), "margin_sum": F.sum(margin)}
    return {
        "total_admissions": Parts({"rows": F.count(F.lit(1))}, F.col("rows"), None),
        "avg_length_of_stay": average("stay", stay),
        "avg_triage_wait": average("wait", wait),
        "avg_satisfaction": average("score", score),
        "gross_billings": Parts({"gross_sum": money["gross_sum"]}, F.col("gross_sum")),
        "readmission_rate_pct": rate("flagged", F.lit(True)),
        "gross_margin": Parts({"margin_sum": money["margin_sum"]}, F.col("margin_sum")),
        "margin_fraction": Parts(money, ratio(F.col("margin_sum"), F.col("gross_sum"))),
        "rushed_rate_pct": rushed,
        "excellent_rate_pct": excellent,
        "relative_risk": Parts(rushed.sums | excellent.sums, ratio(rushed.figure, excellent.figure)),
    }


def measure_cube(
    features: DataFrame, names: Sequence[str], by: Sequence[str], distinct: Mapping[str, str] | None = None,
    known: Mapping[str, Parts] | None = None,
) -> DataFrame:
    """The named measures, and counts of distinct keys, for every subset of the slicers ``by``.

    ``distinct`` maps a result column to an integer key column; a NULL key is not counted. A slicer that a subset leaves
    out is NULL, and ``slice`` tells it from a slicer that is NULL in the facts: its highest bit is set where the first
    slicer is left out, as in GROUPING_ID. Bitmaps are compact for keys that lie close together; sparse ones should be
    numbered first.
    """
    known = parts() if known is None else known
    wanted = {n: known[n] for n in names}
    sums = {s: column for p in wanted.values() for s, column in p.sums.items()}
    distinct, by = dict(distinct or {}), list(by)
    keys = [f"_key_{i}" for i in range(len(distinct))]
    facts = features.withColumns({k: F.col(c) for k, c in zip(keys, distinct.values())}).withColumns({f"_{b}": F.col(b) for b in by})
    held = [f"_{b}" for b in by]

    # facts -> one row per full slice and key, for each kind of key
    if keys:
        sets = [[*held, k] for k in keys]
        kind = F.grouping_id(*held, *keys).alias("_kind")
        per_key = facts.groupingSets([[F.col(c) for c in s] for s in sets], *held, *keys).agg(kind, *[c.alias(s) for s, c in sums.items()])
        # grouping_id sets the bit of every column that a set leaves out
        kinds = [(1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i in range(len(keys))]
    else:
        per_key = facts.groupBy(*held).agg(F.lit(0).alias("_kind"), *[c.alias(s) for s, c in sums.items()])
        kinds = [0]
    own = F.coalesce(*[F.col(k) for k in keys]).cast("long") if keys else F.lit(None).cast("long")

    # keys -> bitmaps of a full slice
    bucketed = per_key.withColumns({"_bucket": F.bitmap_bucket_number(own), "_bit": F.bitmap_bit_position(own)})
    full = bucketed.groupBy(*held, "_kind", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"), *[F.sum(s).alias(s) for s in sums])

    # full slices -> every subset of the slicers
    rest = [F.col("_kind"), F.col("_bucket")]
    subsets = [[*map(F.col, s), *rest] for n in range(len(held), -1, -1) for s in combinations(held, n)]
    united = full.groupingSets(subsets, *held, *rest).agg(
        F.grouping_id(*held, "_kind", "_bucket").alias("_set"), F.bitmap_or_agg("_map").alias("_map"), *[F.sum(s).alias(s) for s in sums]
    )

    # bitmaps -> counts; the sums are in the rows of every kind, and are taken from the first
    counted = [F.sum(F.when(F.col("_kind") == k, F.bitmap_count("_map"))).alias(name) for k, name in zip(kinds, distinct)]
    totals = [F.sum(F.when(F.col("_kind") == kinds[0], F.col(s))).alias(s) for s in sums]
    sliced = united.groupBy(*held, "_set").agg(*totals, *counted)
    figures = [(p.figure if p.digits is None else half_up(p.figure, p.digits)).alias(n) for n, p in wanted.items()]
    return sliced.select(
        *[F.col(h).alias(b) for h, b in zip(held, by)], F.shiftright("_set", 2).cast("long").alias("slice"), *figures,
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in distinct],
    )
