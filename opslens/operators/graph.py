"""Connected components of links between values of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for the nodes of ``a, b``.

    In turn every node hands the least node it knows to its larger and to its smaller neighbours, which halves long
    chains. Each round is stored; the number of rounds grows with the logarithm of the longest chain.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a")
        after = stored(smaller.select("a", F.col("m").alias("b")).unionByName(smaller.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        changed = not after.exceptAll(now).isEmpty()
        now = after
        if not changed:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
