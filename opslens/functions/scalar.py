"""Scalar and aggregate column expressions.

Everything here returns a native ``Column``: nothing crosses into Python at run time.
Division always goes through ``try_divide`` because ANSI mode raises on a zero divisor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero and return a double.

    The step over decimal(38,10) absorbs the last-bit noise of floating-point sums, so the result does not
    depend on the order in which partitions were added up.
    """
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(value: Column) -> Column:
    """Average of the non-NULL values. Exact for decimals, whose ``avg`` would round to four extra digits."""
    return ratio(F.sum(value), F.count(value))


def percent(numerator: Column, denominator: Column) -> Column:
    return F.lit(100.0) * ratio(numerator, denominator)


def rate_pct(flag: Column) -> Column:
    """100 * SUM(flag) / COUNT(*): rows with a NULL flag stay in the denominator."""
    return percent(F.sum(flag), F.count(F.lit(1)))


def rate_of_known_pct(flag: Column) -> Column:
    """100 * mean(flag): rows with a NULL flag are left out."""
    return F.lit(100.0) * mean(flag)


def z_score(value: Column, average: Column, deviation: Column) -> Column:
    return ratio(value - average, deviation)


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]. NULL stays NULL, which ``greatest``/``least`` would turn into a bound."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)


def width_bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Left-closed equal-width bucket number, 0 below the range and ``buckets + 1`` from ``high`` on."""
    return F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets)).cast("int")


def bin_index(value: Column, edges: Sequence[float], right: bool = True) -> Column:
    """0-based bin number for ascending ``edges``; NULL outside them. Bins are right-closed by default."""
    chain = None
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        inside = ((value > low) & (value <= high)) if right else ((value >= low) & (value < high))
        chain = F.when(inside, F.lit(i)) if chain is None else chain.when(inside, F.lit(i))
    return chain


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label of the bin that ``value`` falls in; NULL outside the edges."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    names = F.array(*[F.lit(x) for x in labels])
    return F.get(names, bin_index(value, edges, right))


def upper_bands(value: Column, bands: Sequence[tuple[float, str]], last: str) -> Column:
    """Searched CASE over ascending upper bounds (exclusive); ``last`` takes the rest, NULL included."""
    chain = None
    for bound, label in bands:
        test = value < bound
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(last)


def month_start(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "MM")


def month_label(moment: Column) -> Column:
    return F.date_format(moment.cast("date"), "yyyy-MM")


def is_weekend(moment: Column) -> Column:
    """Saturday or Sunday; ``weekday`` counts from Monday = 0."""
    return F.weekday(moment.cast("date")) >= 5


def day_type(moment: Column) -> Column:
    return F.when(is_weekend(moment), "Weekend").otherwise("Weekday")


def in_months(moment: Column, months: Sequence[int]) -> Column:
    return F.month(moment).isin(*months)


def age_years(moment: Column, birth: Column) -> Column:
    """Whole days between the dates over 365.25, to one decimal; negative when the birth comes later."""
    return half_up(F.datediff(moment.cast("date"), birth.cast("date")) / F.lit(365.25), 1)


def add_days(moment: Column, days: Column) -> Column:
    """Timestamp plus a fractional number of days, to the second."""
    return F.timestamp_add("SECOND", F.round(days.cast("double") * F.lit(86400.0)).cast("int"), moment)


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def calendar_factor(moment: Column, by_month: dict[int, float], weekend: float = 1.0) -> Column:
    """Seasonal factor of the month (1.0 where none is given) times the weekend factor."""
    factor = F.lit(1.0)
    if by_month:
        chain = None
        for month, value in by_month.items():
            test = F.month(moment) == month
            chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
        factor = chain.otherwise(F.lit(1.0))
    return factor * F.when(is_weekend(moment), F.lit(weekend)).otherwise(F.lit(1.0))


def millions_label(amount: Column) -> Column:
    """Money label such as ``$499.3M``."""
    return F.format_string("$%.1fM", amount.cast("double") / F.lit(1e6))


def thousands_label(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number, 0)
