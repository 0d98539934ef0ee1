"""Spelling variants of a label found without a key.

Labels are counted first, so everything after that works on distinct spellings. They are compared by their letters and
digits in lower case. Two of them are variants if these are equal or one edit apart: a letter more, less or replaced, or
two neighbours swapped. Digits are never edited, as figures tell labels apart, and short labels are only matched as they are.

Links are found by blocks, not by pairs. A block is a text with a letter left out at a place: its members are one
replacement apart from each other, all of them, so each links to the least member, and a block of any size costs as many
links as it has members. A label with one letter more meets the shorter one by an equality join, swapped neighbours
meet at the text with the two in order. Components of the links are the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.graph import components
from opslens.operators.joins import join_lookup
from opslens.session import stored

#: Shortest normalised label that is matched with an edit.
LEAST_LENGTH = 5


def normalised(label: Column) -> Column:
    """Letters and digits in lower case; a label without any stands as it is."""
    plain = F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]+", ""))
    return F.when(plain == "", label).otherwise(plain)


def spelling_links(norms: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``a, b``: links between the distinct values of ``norm`` that are one edit apart; their components are the
    components of all such pairs."""
    n, norm = F.length("norm"), F.col("norm")
    long = norms.where(n >= least_length)
    places = F.sequence(F.lit(1), n)

    def letter(i: Column) -> Column:
        return norm.substr(i, F.lit(1)).rlike(r"\p{L}")

    def without(i: Column) -> Column:
        return F.concat(norm.substr(F.lit(1), i - 1), norm.substr(i + 1, n))

    cut = F.transform(F.filter(places, letter), lambda i: F.struct(i.alias("place"), without(i).alias("rest")))
    cuts = long.select("norm", F.explode(cut).alias("c")).select("norm", "c.*")
    block = Window.partitionBy("place", "rest")
    replaced = cuts.select(norm.alias("a"), F.min("norm").over(block).alias("b"))
    shorter = long.select(norm.alias("rest"), norm.alias("b"))
    longer = cuts.select("norm", "rest").distinct().join(shorter, "rest").select(norm.alias("a"), "b")

    def swapped(i: Column) -> Column:
        x, y = norm.substr(i, F.lit(1)), norm.substr(i + 1, F.lit(1))
        text = F.concat(norm.substr(F.lit(1), i - 1), F.least(x, y), F.greatest(x, y), norm.substr(i + 2, n))
        return F.when((x != y) & (letter(i) | letter(i + 1)), F.struct(i.alias("place"), text.alias("rest")))

    swaps = F.filter(F.transform(F.sequence(F.lit(1), n - 1), swapped), lambda s: s.isNotNull())
    pairs = long.where(n > 1).select("norm", F.explode(swaps).alias("c")).select("norm", "c.*")
    turned = pairs.select(norm.alias("a"), F.min("norm").over(block).alias("b"))
    return replaced.unionByName(longer).unionByName(turned).where("a <> b").distinct()


def variant_clusters(df: DataFrame, label: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Every distinct spelling with its rows, the canonical spelling of its cluster, and the cluster's spellings and rows.

    The canonical spelling is the most frequent one, of equally frequent ones the first in order. NULL is no label.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = stored(counted.withColumn("norm", normalised(F.col("label"))))
    found = components(spelling_links(counted.select("norm").distinct(), least_length))
    joined = counted.join(found.withColumnRenamed("node", "norm"), "norm", "left").withColumn("cluster", F.coalesce("component", "norm"))
    joined = stored(joined.select("label", "n_rows", "cluster"))
    best = F.min(F.struct((-F.col("n_rows")).alias("order"), F.col("label"))).alias("best")
    clusters = joined.groupBy("cluster").agg(best, F.count(F.lit(1)).alias("cluster_spellings"), F.sum("n_rows").alias("cluster_rows"))
    picked = clusters.select("cluster", F.col("best.label").alias("canonical"), "cluster_spellings", "cluster_rows")
    return join_lookup(joined, stored(picked), "cluster").select("label", "n_rows", "canonical", "cluster_spellings", "cluster_rows")


def canonical_spelling(df: DataFrame, label: str, out: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``df`` with the canonical spelling of ``label`` in ``out``; NULL stays NULL."""
    spellings = variant_clusters(df, label, least_length).select(F.col("label").alias(label), F.col("canonical").alias(out))
    return join_lookup(df, stored(spellings), label, "left")
