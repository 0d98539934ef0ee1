"""Foreign keys tested by exact bitmaps of the parent keys.

The keys of a parent are kept as bits: one row for every 64 neighbouring keys of which at least one exists, addressed by
bucket and word. Dense keys need a row in 64 keys, sparse ones a row per key, never more. The rows are measured; while
they are few they are broadcast, and a child table is scanned once for all its foreign keys without any shuffle.

Beyond that the children's keys become bitmaps too, before the shuffle, and only words meet: those with a bit that the
parents lack are then looked up by the child rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.joins import SMALL_ROWS, is_small, join_lookup
from opslens.session import stored

#: Bits of a row.
WORD = 64


def address(key: Column) -> tuple[Column, Column, Column]:
    """Bucket, word and bit of an integer key."""
    key = key.cast("long")
    place = F.bitmap_bit_position(key)
    return F.bitmap_bucket_number(key), F.floor(place / WORD).cast("int"), (place % WORD).cast("int")


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """``bucket, word, bits`` of the keys that exist; a key may occur any number of times, and NULL is left out."""
    bucket, word, bit = address(F.col(key))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    known = rows.where(F.col(key).isNotNull())
    return known.groupBy(bucket.alias("bucket"), word.alias("word")).agg(F.bit_or(one).alias("bits"))


def _addressed(rows: DataFrame, key: str) -> DataFrame:
    bucket, word, bit = address(F.col(key))
    return rows.withColumns({"bucket": bucket, "word": word, "_bit": bit})


def _lost(bits: Column) -> Column:
    """Whether the row's key is missing from the bits of its word; a NULL key is."""
    return F.coalesce(F.bit_get(F.coalesce(bits, F.lit(0).cast("long")), F.col("_bit")) == 0, F.lit(True))


def rows_without_parent(children: DataFrame, foreign_key: str, parents: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Child rows whose key is not in the bitmap ``parents``, or is NULL."""
    placed = _addressed(children, foreign_key)
    if is_small(parents, small_rows):
        found = placed.join(F.broadcast(parents), ["bucket", "word"], "left")
        return found.where(_lost(F.col("bits"))).select(*children.columns)
    own = bitmap(children, foreign_key).withColumnRenamed("bits", "own")
    both = own.join(parents, ["bucket", "word"], "left")
    gone = both.select("bucket", "word", F.col("own").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("gone"))
    gone = stored(gone.where("gone <> 0"))
    known = join_lookup(placed.where(F.col(foreign_key).isNotNull()), gone, ["bucket", "word"], small_rows=small_rows)
    lost = known.where(F.bit_get(F.col("gone"), F.col("_bit")) == 1).select(*children.columns)
    return lost.unionByName(children.where(F.col(foreign_key).isNull()))


def foreign_key_rules(
    children: DataFrame, links: Mapping[str, tuple[str, DataFrame]], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Rows ``rule, violations, passed`` of a child table; ``links`` maps a rule to its foreign key and the parents' bitmap.

    A child row without a parent violates the rule, and so does a NULL key. Rules whose bitmaps are small share one scan.
    """
    small = {rule: link for rule, link in links.items() if is_small(link[1], small_rows)}
    results = []
    if small:
        keys = list(dict.fromkeys(key for key, _ in small.values()))
        frame, tests = children.select(*keys), {}
        for i, (rule, (key, parents)) in enumerate(small.items()):
            named = parents.withColumnsRenamed({"bits": f"_bits{i}"})
            frame = _addressed(frame, key).join(F.broadcast(named), ["bucket", "word"], "left")
            frame = frame.withColumn(f"_lost{i}", _lost(F.col(f"_bits{i}"))).select(*keys, *[f"_lost{j}" for j in range(i + 1)])
            tests[rule] = F.struct(F.lit(rule).alias("rule"), F.count_if(F.col(f"_lost{i}")).alias("violations"))
        counts = frame.agg(F.array(*tests.values()).alias("rules"))
        results.append(counts.select(F.explode("rules").alias("r")).select("r.*"))
    for rule, (key, parents) in links.items():
        if rule not in small:
            lost = rows_without_parent(children.select(key), key, parents, small_rows)
            results.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations"))
    out = results[0]
    for result in results[1:]:
        out = out.unionByName(result)
    return out.withColumn("passed", F.col("violations") == 0)
