"""SimHash near-dedup by anchor-point covering.

The 64 bits of a fingerprint are cut into three parts. Two fingerprints at 4 or fewer differing bits differ in at most
one bit of some part. The anchors of a part are the 4096 words of the binary Golay code, whose covering radius is 3:
every part lies within 3 bits of exactly one anchor, and a part that differs from it in one bit lies within 4 bits of
the same anchor. So each fingerprint is sent, for each part, to all anchors within 3 + 1 bits (one or six of them), and
linked fingerprints meet at an anchor. More bits are allowed by sending to anchors that much farther out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import components, per_batch, utf8
from opslens.session import stored

SHINGLE_WORDS, MAX_BITS = 4, 4
#: Lowest bit and width of each part of a fingerprint.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one anchor that are compared in one task at most, with as many others.
BLOCK = 8192
_SHINGLES_AT_ONCE = 1 << 16
_GENERATOR, _CODE_BITS, _RADIUS = 0xC75, 23, 3


# -- fingerprints ----------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the shingles of A-Z-lowered words, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        upto = at + _SHINGLES_AT_ONCE
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:upto], ends[at:upto])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) for every row; a null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle) for x in utf8(batch.column(1))], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", run)


# -- anchors ---------------------------------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(_CODE_BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def anchor_masks(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every syndrome the differences to all code words within ``3 + extra`` bits, padded with -1, and the
    syndromes of the lower 12 and the upper 11 bits of a word, which add up to the word's."""
    lower = np.array([_remainder(x) for x in range(1 << 12)])
    upper = np.array([_remainder(x << 12) for x in range(1 << 11)])
    code = np.array([x << 11 | _remainder(x << 11) for x in range(1 << 12)])
    leaders = np.zeros(1 << 11, np.int64)
    for n in range(_RADIUS + 1):
        for bits in combinations(range(_CODE_BITS), n):
            pattern = sum(1 << b for b in bits)
            leaders[lower[pattern & 0xFFF] ^ upper[pattern >> 12]] = pattern
    near = [leader ^ code[np.bitwise_count(leader ^ code) <= _RADIUS + extra] for leader in leaders]
    masks = np.full((len(near), max(map(len, near))), -1, np.int64)
    for row, found in zip(masks, near):
        row[: len(found)] = found
    return masks, lower, upper


def anchored(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``anchor, fp``: every fingerprint at each of its anchors; at least one part differs in ``max_bits // 3`` bits or fewer."""
    sent = fps.sparkSession.sparkContext.broadcast(anchor_masks(max_bits // len(PARTS)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, lower, upper = sent.value
        fp = batch.column(0).to_numpy().view(np.uint64)
        anchors, owners = [], []
        for number, (low, width) in enumerate(PARTS):
            part = (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
            near = masks[lower[part & 0xFFF] ^ upper[part >> 12]]
            row, _ = held = np.nonzero(near >= 0)
            anchors.append((number << _CODE_BITS) | (part[row] ^ near[held]))
            owners.append(fp[row].view(np.int64))
        return pa.record_batch([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(owners))], ["anchor", "fp"])

    return per_batch(fps.select("fp"), "anchor long, fp long", run)


# -- comparison at an anchor -----------------------------------------------------------------------------------------


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what links of at most ``max_bits`` bits connect: fewer edges than fingerprints.

    A first pass drops fingerprints without a partner; then every tree grows by comparing a member with those that
    no tree has reached yet.
    """
    n = len(fps)
    partner = np.zeros(n, bool)
    step = max(1, (1 << 21) // max(n, 1))
    for at in range(0, n, step):
        partner[at : at + step] = (np.bitwise_count(fps[at : at + step, None] ^ fps[None]) <= max_bits).sum(axis=1) > 1
    free = fps[partner]
    a, b = [], []
    while len(free):
        reached, free = [free[0]], free[1:]
        while reached and len(free):
            one = reached.pop()
            near = np.bitwise_count(free ^ one) <= max_bits
            if near.any():
                found, free = free[near], free[~near]
                a.append(np.full(len(found), one))
                b.append(found)
                reached.extend(found)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(a), join(b)


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: a spanning set of the links between distinct fingerprints.

    The members of a large anchor are dealt into blocks by hash, and every pair of blocks is a group of its own, so
    that no task holds more than two blocks of an anchor. The table of anchor sizes has 3 * 4096 rows at most.
    """
    rows = stored(anchored(fps, max_bits))
    sizes = rows.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    large = F.broadcast(sizes.where("blocks > 1"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = rows.join(large, "anchor", "left").select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    keyed = dealt.select("anchor", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")

    def run(table: pa.Table) -> pa.Table:
        a, b = forest(table["fp"].to_numpy().view(np.uint64), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.groupBy("anchor", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: components of fingerprints that are linked at ``max_bits``
    or fewer differing bits, named by their smallest doc_id.

    Exact copies share a fingerprint and cross the shuffle as one row per task. Null and empty texts have fingerprint
    zero. Rows with a null doc_id are kept and take part; a component of such rows only has a null id. Repeated rows
    are returned as often as they are given; further columns are ignored. An empty table gives an empty result.
    """
    found = stored(fingerprints(docs, shingle, id_col, text_col))
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = stored(components(links(distinct, max_bits, block)))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    joined = groups.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    labels = stored(distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    # both sides are plain scans here, so that the rows of a frequent fingerprint can be split over tasks
    return found.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
