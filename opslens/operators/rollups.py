"""Sums over foreign keys: aggregate on each key first, join the parent afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """Step from ``key`` of the frame so far to ``parent.parent_key``, picking up the columns ``keep``."""

    key: str
    parent: DataFrame
    parent_key: str
    keep: Sequence[str] = field(default_factory=tuple)


def sums_along(facts: DataFrame, hops: Sequence[Hop], by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """SUM of each of ``totals`` per ``by``, where the group columns are reached through ``hops``.

    Facts are summed per foreign key before every join. A key that holds a third of the facts then reaches the
    shuffle as one partial row per task, and the join sees one row per key. Rows without a parent drop out, as
    in an inner join.
    """
    by = list(by)
    partial = {f"_total_{name}": column for name, column in totals.items()}
    again = {name: F.col(name) for name in partial}

    def summed(frame: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
        return frame.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in columns.items()])

    frame, columns = facts, partial
    for hop in hops:
        known = [c for c in by if c in frame.columns and c != hop.key]
        frame, columns = summed(frame, [hop.key, *known], columns), again
        parent = hop.parent.select(F.col(hop.parent_key).alias(hop.key), *[c for c in hop.keep if c != hop.key])
        frame = frame.join(parent, hop.key)
    return summed(frame, by, columns).select(*by, *[F.col(f"_total_{name}").alias(name) for name in totals])
