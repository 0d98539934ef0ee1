"""Reproducible sampling and exact splits by a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from opslens.operators.joins import join_lookup, settle
from opslens.operators.running import numbered
from opslens.session import stored

SLOT_BITS = 16  # leading bits of the hash by which rows are counted before a split
HASH_DIGITS = 13  # hex digits of the hash in use: 52 bits, exact in a double as well


def key_text(key: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key])


def key_hash(key: Sequence[str]) -> Column:
    """First 52 bits of the md5 of the key: the same on every run and for any partitioning."""
    return F.conv(F.substring(F.md5(key_text(key)), 1, HASH_DIGITS), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: Sequence[str], fraction: float) -> DataFrame:
    """Rows whose key hash falls below ``fraction`` of the hash range."""
    return df.where(key_hash(key) < F.lit(int(fraction * 16**HASH_DIGITS)))


def stratified_split(df: DataFrame, label: str, key: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Add ``split``: exactly floor(share * n) rows of each class, by lowest key hash, become 'train'.

    The hash is uniform, so the rows of a class are counted by its leading bits; the counts name the slot that holds
    the cut, and only that slot (one row in 65,536) is put in order. ``key`` should identify a row; rows that share
    the hash at the cut are interchangeable, and as many as needed are taken.
    """
    hashed = df.select("*", F.struct(label).alias("_group"), key_hash(key).alias("_hash"))
    # counting passes read the hashes only, which are taken once
    slim = stored(hashed.select("_group", "_hash"))
    slot = F.shiftright("_hash", 4 * HASH_DIGITS - SLOT_BITS).alias("_slot")
    counts = slim.groupBy("_group", slot).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.floor(F.sum("_n").over(Window.partitionBy("_group")) * F.lit(float(train_share))).alias("_train")
    upto = F.sum("_n").over(_before("_slot")).alias("_upto")
    at_cut = (F.col("_upto") - F.col("_n") < F.greatest("_train", F.lit(1))) & (F.greatest("_train", F.lit(1)) <= F.col("_upto"))
    slots = settle(
        counts.select("_group", "_slot", "_n", wanted, upto).where(at_cut)
        .select("_group", "_slot", (F.col("_train") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )
    inside = join_lookup(slim.select("_group", slot, "_hash"), slots, ["_group", "_slot"])
    ranked = inside.groupBy("_group", "_left", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.withColumn("_upto", F.sum("_n").over(_before("_hash")))
    least = F.greatest("_left", F.lit(1))
    cuts = settle(
        ranked.where((F.col("_upto") - F.col("_n") < least) & (least <= F.col("_upto")))
        .select("_group", F.col("_hash").alias("_cut"), F.col("_n").alias("equal"), (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_take"))
    )
    tagged = join_lookup(hashed, cuts.drop("equal"), "_group")
    columns = [*df.columns, "split"]
    if cuts.where((F.col("_take") != F.col("equal")) & (F.col("_take") != 0)).isEmpty():
        # All rows at the cut fall on the same side, so nothing needs ranking.
        train = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & (F.col("_take") > 0))
        return tagged.withColumn("split", F.when(train, "train").otherwise("test")).select(*columns)
    clear = tagged.where(F.col("_hash") != F.col("_cut"))
    clear = clear.withColumn("split", F.when(F.col("_hash") < F.col("_cut"), "train").otherwise("test"))
    same = numbered(tagged.where(F.col("_hash") == F.col("_cut")), "_group", "_place")
    same = same.withColumn("split", F.when(F.col("_place") <= F.col("_take"), "train").otherwise("test"))
    return clear.select(*columns).unionByName(same.select(*columns))


def _before(order: str) -> WindowSpec:
    return Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
