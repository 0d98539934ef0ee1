"""Two copies of a table compared from the top down.

Rows are hashed where they are read and summed to checksums of key ranges, which do not depend on order. Only the
checksums are shuffled. Ranges whose checksums agree are done; the others are read again with ranges ``FANOUT`` times
narrower, until the rows in them are few or a range is one key. Those rows alone are then compared key by key. Two equal
copies cost one scan each, and a shuffle of at most ``FANOUT`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.joins import join_lookup
from opslens.session import stored

#: Ranges that a range is cut into, and rows that are compared without narrower ranges.
FANOUT, LEAF_ROWS = 1024, 100_000
#: Most key intervals that are pushed into the scan as a filter.
PUSHED = 64
MISSING, EXTRA, CHANGED = "missing", "extra", "changed"


def row_hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of a row's values, NULLs in their places."""
    values = [v for c in columns for v in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)


def range_of(key: str, low: int, width: int) -> Column:
    """Number of the key's range; -1 for rows without a key."""
    return F.coalesce(F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))


def checksums(rows: DataFrame, key: str, columns: Sequence[str], low: int, width: int, side: str) -> DataFrame:
    """``range`` and, for a side, rows, the exclusive or of one hash and the sum of 24 bits of the other."""
    first, second = row_hashes([key, *columns])
    return rows.groupBy(range_of(key, low, width).alias("range")).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), F.bit_xor(first).alias(f"{side}_xor"), F.sum(F.shiftrightunsigned(second, 40)).alias(f"{side}_sum")
    )


def _unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.join(right, "range", "full")
    same = [F.col(f"left_{x}").eqNullSafe(F.col(f"right_{x}")) for x in ("rows", "xor", "sum")]
    n = F.coalesce("left_rows", F.lit(0)) + F.coalesce("right_rows", F.lit(0))
    return both.where(~(same[0] & same[1] & same[2])).select("range", n.alias("n"))


def _within(rows: DataFrame, key: str, ranges: DataFrame, low: int, width: int) -> DataFrame:
    """Rows of some ranges: as a filter on the key that reaches the scan where the ranges are few, else by look-up."""
    some = ranges.select("range").limit(PUSHED + 1).collect()
    if len(some) > PUSHED:
        numbered = rows.withColumn("range", range_of(key, low, width))
        return join_lookup(numbered, ranges.select("range"), "range", "left_semi").drop("range")
    test = F.lit(False)
    for (number,) in some:
        start = low + number * width
        test = test | (F.col(key).isNull() if number < 0 else F.col(key).between(start, start + width - 1))
    return rows.where(test)


def differences(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ as multisets: ``key, left_rows, right_rows, status``."""
    first, second = row_hashes([key, *columns])
    sides = left.select(F.col(key).alias("key"), first.alias("a"), second.alias("b"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key).alias("key"), first.alias("a"), second.alias("b"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_row = sides.groupBy("key", "a", "b").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    per_key = per_row.groupBy("key").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.bool_or(F.col("l") != F.col("r")).alias("differs")
    )
    status = F.when(F.col("right_rows") == 0, MISSING).when(F.col("left_rows") == 0, EXTRA).otherwise(CHANGED)
    return per_key.where("differs").select("key", "left_rows", "right_rows", status.alias("status"))


def drilldown(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """What is missing from, extra in, or changed in the ``right`` copy: ``key, left_rows, right_rows, status``.

    ``key`` is an integer column. Keys may repeat: rows of a key are compared as a multiset. Rows without a key are a
    range, and a key, of their own.
    """
    left, right = left.select(key, *columns), right.select(key, *columns)
    ends = left.select(key).unionByName(right.select(key)).agg(F.min(key), F.max(key)).first()
    low, high = (int(x) if x is not None else 0 for x in ends)
    width = max(1, -(-(high - low + 1) // fanout))
    while True:
        sums = [checksums(rows, key, columns, low, width, side) for rows, side in ((left, "left"), (right, "right"))]
        unequal = stored(_unequal(*sums))
        n = unequal.agg(F.sum("n")).first()[0]
        if not n:
            schema = differences(left, right, key, columns).schema
            return left.sparkSession.createDataFrame([], schema)
        left, right = (_within(rows, key, unequal, low, width) for rows in (left, right))
        if n <= leaf_rows or width == 1:
            return differences(left, right, key, columns)
        width = -(-width // fanout)
