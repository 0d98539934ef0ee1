"""Rules judged while a table is written, in the same pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from opslens.operators.quality import require


def observed_write(
    df: DataFrame, rules: Mapping[str, Column], write: Callable[[DataFrame], object], null_passes: bool = False
) -> DataFrame:
    """Hands ``df`` to ``write`` and returns ``rule, violations, passed`` for its rows, with a first row that counts them.

    The rules are counted as the rows go by. A test that comes out NULL breaks the rule, or passes with ``null_passes``.
    ``write`` must run exactly one action over all rows of the frame it gets.
    """
    seen = Observation()
    counts = {f"rule_{i}": F.count_if(~F.coalesce(test, F.lit(null_passes))) for i, test in enumerate(rules.values())}
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()]))
    found = seen.get
    rows = [("rows written", found["rows"], True), *((rule, found[f"rule_{i}"], found[f"rule_{i}"] == 0) for i, rule in enumerate(rules))]
    return df.sparkSession.createDataFrame(rows, "rule string, violations long, passed boolean")


def gated_write(df: DataFrame, rules: Mapping[str, Column], write: Callable[[DataFrame], object], publish: Callable[[], object]) -> DataFrame:
    """Writes and judges ``df`` in one pass, and runs ``publish`` only if no rule is broken; else raises."""
    judged = observed_write(df, rules, write)
    require(judged)
    publish()
    return judged
