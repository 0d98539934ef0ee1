"""Joins against keyed lookups, safe for lookups of any size and for hot keys.

A lookup is a frame with one row per key: a dimension, or per-group statistics of the facts themselves.

* ``settle`` evaluates a lookup that is expected to be small. Up to ``SMALL_ROWS`` rows come back as a local
  relation whose size Spark knows exactly; a larger one is stored as a table in the checkpoint folder.
* A lookup that may well be large is ``stored`` at once; nothing of it passes through the driver.
* ``join_lookup`` measures the lookup and broadcasts it when it is small, as a local relation always is. A larger
  lookup is joined by a shuffle in which the rows of hot keys are spread: a key that holds the rows of n average
  partitions gets n salts, and its lookup row is repeated n times. All repeats together are about one row per
  shuffle partition, and the facts are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.session import stored

SMALL_ROWS = 200_000
SMALL_BYTES = 64 * 1024**2
HOT_PARTITIONS = 2.0  # a key is hot when it holds more rows than this many average shuffle partitions
HOT_SAMPLE = 0.01


def settle(lookup: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Evaluate ``lookup`` now and return an equal frame that is cheap to use several times.

    A lookup with text is stored first, and comes to the driver only if its bytes are known to be few.
    """
    wide = _wide(lookup)
    if wide:
        lookup = stored(lookup)
        if not is_small(lookup, small_rows):
            return lookup
    head = lookup.limit(small_rows + 1).toArrow()
    if head.num_rows <= small_rows:
        return lookup.sparkSession.createDataFrame(head, schema=lookup.schema)
    return stored(lookup)


def is_small(lookup: DataFrame, small_rows: int = SMALL_ROWS) -> bool:
    """Whether the lookup may be broadcast: a local relation, or one counted in rows and, for text, in bytes."""
    if lookup.isLocal():
        return True
    if lookup.count() > small_rows:
        return False
    text = _wide(lookup)
    if not text:
        return True
    size = sum(F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0)) for name in text)
    return lookup.agg(size).first()[0] <= SMALL_BYTES


def _wide(lookup: DataFrame) -> list[str]:
    """Columns whose values have no fixed size."""
    return [name for name, kind in lookup.dtypes if any(part in kind for part in ("string", "binary", "array", "map"))]


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    *,
    small_rows: int = SMALL_ROWS,
    hot_sample: float = HOT_SAMPLE,
) -> DataFrame:
    """Join ``facts`` to a lookup that is unique on ``on``; ``how`` is inner, left, left_semi or left_anti."""
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(lookup, small_rows):
        return facts.join(F.broadcast(lookup), keys, how)
    hot = hot_keys(facts, keys, hot_sample)
    if hot.isEmpty():
        return facts.join(lookup, keys, how)
    # The salt is the number of the task that reads the row: even over the salts, the same when a task is run
    # again, and no further column has to be read for it.
    everywhere = F.lit(shuffle_partitions(facts))
    salts = F.coalesce(F.when(_all_known(keys), F.col("_salts")).otherwise(everywhere), F.lit(1))
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.spark_partition_id(), salts))
    repeats = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = lookup.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(repeats))
    return salted.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(facts: DataFrame, keys: Sequence[str], sample: float = HOT_SAMPLE) -> DataFrame:
    """Keys with the rows of more than ``HOT_PARTITIONS`` average partitions, and how many salts each should get.

    There are at most (partitions / HOT_PARTITIONS) such keys, and never more than ``SMALL_ROWS``. Keys with a NULL
    count as one key, all NULL: they match nothing, but would meet in one task of a shuffle. The sample only
    decides how a row travels; a key missed here is joined all the same.
    """
    picked = facts.sample(fraction=sample, seed=7) if sample < 1.0 else facts
    known, partitions = _all_known(keys), shuffle_partitions(facts)
    counts = picked.groupBy(*[F.when(known, F.col(k)).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("t"))
    share = F.col("_rows") / total.scalar()
    least = max(HOT_PARTITIONS / partitions, 1 / SMALL_ROWS)
    salts = F.ceil(share * partitions).cast("int").alias("_salts")
    return settle(counts.where(share > least).select(*keys, salts))


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def join_equal(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` lookup join in which NULLs in a key count as equal."""
    keys = right.select(F.struct(*on).alias("_key"))
    return join_lookup(left.withColumn("_key", F.struct(*on)), keys, "_key", how).drop("_key")


def orphan_counts(children: DataFrame, foreign_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child key values without a parent (NULL among them), with their row counts.

    Children are counted and parents made distinct per key before the join, so a key that holds most of the rows
    of either side crosses the shuffle as one row per task.
    """
    counted = children.groupBy(F.col(foreign_key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(parents.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")
