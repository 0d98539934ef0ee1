"""Merkle manifest of a dataset by concatenated level strings.

A tree's nodes stand in a fixed order. Aligned blocks of 3**6 neighbouring nodes keep each of their levels as one string
of hex digests, 64 characters a node: the parents of a level are the digests of its substrings of three nodes, and the
siblings of a node are the substrings that flank it in its run. The roots of the blocks are the nodes of the next round,
which does the same, until each tree has one root. So no task holds more than a block, however many rows a source has.

Rows are placed by a range partitioning and a count for each partition, not by one sorted window. The subroots of the
sources form a tree of their own in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.joins import join_lookup, settle
from opslens.session import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
DIGEST = 64
_POWERS = [ARITY**i for i in range(40)]


# -- leaves ----------------------------------------------------------------------------------------------------------


def _encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(_encoded, values)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the CRC-32 of the id; a row without an id is left alone."""
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


# -- places ----------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order``) and ``size`` of the row's ``tree``.

    Rows are range-partitioned and sorted, and stored with their number in the partition, so that it stays the same
    when a task is run again. What a partition holds of a tree lies side by side; its place follows from the counts of
    the partitions before it.
    """
    keys = ["tree", *order]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    numbered = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = numbered.groupBy("tree", part).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    # one row per partition of the shuffle and tree
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    joined = join_lookup(numbered.withColumn("_part", part), settle(offsets), ["tree", "_part"])
    return joined.withColumn("pos", row + F.col("_shift")).drop("_id", "_part", "_shift")


# -- trees -----------------------------------------------------------------------------------------------------------


def _parent_of(level: Column, width: int) -> Callable[[Column], Column]:
    return lambda run: F.sha2(level.substr(run * width + 1, F.lit(width)), 256)


def _levels(blocks: DataFrame) -> DataFrame:
    """Adds ``steps`` (levels that a block climbs) and the strings ``l0`` to ``l6`` of its levels.

    A level string that is the block's last one is repeated in the columns above it.
    """
    depth = F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.col("size")))
    blocks = blocks.withColumn("steps", F.least(F.lit(LEVELS), depth))
    blocks = blocks.withColumn("l0", F.array_join(F.transform("items", lambda x: x["hash"]), "").cast("binary"))
    for j in range(LEVELS):
        below, width = F.col(f"l{j}"), ARITY * DIGEST
        runs = F.sequence(F.lit(0), F.floor((F.octet_length(below) - 1) / width).cast("int"))
        above = F.array_join(F.transform(runs, _parent_of(below, width)), "").cast("binary")
        blocks = blocks.withColumn(f"l{j + 1}", F.when(F.col("steps") > j, above).otherwise(below))
    return blocks


def _path(pos: Column) -> Column:
    """Siblings left and right of a block's node, level by level up to the block's root."""
    steps = []
    for j in range(LEVELS):
        p = F.floor(F.pmod(pos, F.lit(BLOCK)) / ARITY**j).cast("int")
        at, level = p % ARITY, F.col(f"l{j}")
        left = level.substr((p - at) * DIGEST + 1, at * DIGEST).cast("string")
        right = level.substr((p + 1) * DIGEST + 1, (ARITY - 1 - at) * DIGEST).cast("string")
        steps.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("steps"))


_NO_PATH = "cast(array() as array<struct<left string, right string>>)"


def climbed(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes ``tree, pos, size, hash`` with their level strings and the path ``above`` them, and ``tree, root``.

    ``items`` holds a block's nodes in order, with the columns of ``payload``.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "hash", *payload)))
    grouped = nodes.groupBy("tree", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"))
    blocks = stored(_levels(grouped))
    top = F.col(f"l{LEVELS}").cast("string")
    most = blocks.agg(F.max("size")).first()[0]
    if (most or 0) <= BLOCK:
        return blocks.withColumn("above", F.expr(_NO_PATH)), blocks.select("tree", top.alias("root"))
    size = F.floor((F.col("size") + BLOCK - 1) / BLOCK)
    upper, roots = climbed(blocks.select("tree", F.col("block").alias("pos"), size.alias("size"), top.alias("hash")), [])
    paths = F.transform("items", lambda x: F.struct(x["pos"].alias("block"), F.concat(_path(x["pos"]), F.col("above")).alias("above")))
    above = stored(upper.select("tree", F.explode(paths).alias("p")).select("tree", "p.*"))
    return join_lookup(blocks, above, ["tree", "block"]), roots


def _folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot of its source, root, proof and the root folded from a tampered copy, for every row.

    ``proof_sha256`` is the digest of all siblings from the leaf over the subroot to the root, ``folded_root`` what the
    (tampered) leaf gives with these siblings. Null fields are ``-`` in a leaf; rows without a source form a tree of
    their own, the first one; rows without an id come first in their source and are never tampered with. Rows with
    equal ids are ordered by their leaf, so repeated rows are neighbours with the same leaf and proofs of their own.
    An empty table has an empty manifest; other columns are ignored.
    """
    docs = docs.select(*FIELDS)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    # the empty name sorts before all names with a prefix
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit(""))
    hashed = docs.select(
        tree.alias("tree"), "doc_id", leaf(doc_id, source, lang, n_chars, text).alias("hash"),
        leaf(doc_id, source, lang, n_chars, tampered(doc_id, text)).alias("shown"),
    )
    blocks, roots = climbed(placed(stored(hashed), ["doc_id", "hash"]), ["doc_id", "shown"])
    subroots = stored(roots.select(F.col("tree").alias("name"), F.col("root").alias("hash"), F.lit("").alias("tree")))
    tops, whole = climbed(placed(subroots, ["name"]), ["name"])
    path = F.transform("items", lambda x: F.struct(x["name"].alias("tree"), x["hash"].alias("subroot"), F.concat(_path(x["pos"]), F.col("above")).alias("over")))
    over = stored(tops.select(F.explode(path).alias("p")).select("p.*"))
    joined = join_lookup(blocks, over, "tree").withColumn("root", whole.select("root").scalar())

    def row(x: Column) -> Column:
        path = F.concat(_path(x["pos"]), F.col("above"), F.col("over"))
        siblings = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
        return F.struct(
            x["doc_id"].alias("doc_id"), x["hash"].alias("leaf"),
            F.sha2(siblings, 256).alias("proof_sha256"), _folded(x["shown"], path).alias("folded_root"),
        )

    rows = joined.select("subroot", "root", F.explode(F.transform("items", row)).alias("r"))
    return rows.select(
        "r.doc_id", "r.leaf", "subroot", "root", "r.proof_sha256", "r.folded_root", (F.col("r.folded_root") == F.col("root")).alias("verified")
    )
