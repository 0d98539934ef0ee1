"""Prefix trie of conversations as a z-fast trie.

A node of the trie is a sequence of first turns, known by the hash of that prefix. Only compacted nodes are kept: one for
each sequence at which conversations part or end, with the edge of single-child nodes above it. A compacted node with
depths ``low + 1`` to ``high`` is found by its handle, the prefix at the two-fattest depth in that range (the one that the
highest power of two divides).

*Search.* For a new sequence, a binary search over depths by two-fattest numbers looks up one handle per step: a hit
raises the lower bound to the depth where the found node ends, a miss lowers the upper one. After about log2 of the
length it knows the deepest node that is a prefix of the sequence; the edge below that is found by its first prefix.

*Insertion.* Distinct sequences are inserted in batches of a random order, each a number of times as large as all before it.
All sequences of a batch are searched together, a join with the handles per step. Then the edges in which they part are
cut, and sequences that leave at the same place with the same next turn are put into a small trie of their own. Among
random insertions those are neighbours without an earlier one between them, so their number grows with the logarithm of
the input and not with the number of conversations that share a beginning.

*Expansion.* Figures of a subtree are summed over the paths of compacted nodes to the root, with partial sums before the
shuffle, and every edge is expanded to its nodes at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import small_batches
from opslens.operators.joins import join_lookup
from opslens.session import stored

#: Rows of a group that begin alike, first turns taken from another conversation, and the pattern of a word.
GROUP, MOST_TAKEN, WORD = 20, 4, r"[^\x20\x09-\x0D]+"
#: Distinct sequences of the first batch, and growth from batch to batch.
FIRST_BATCH, GROWTH = 512, 16
_ROOT = bytes(16)
_NODES = "node binary, parent binary, low int, high int, edge array<binary>, before long, sums array<long>"
_SLOTS = 1 << 30
#: Ids that are hashed together.
_CHUNK = 1 << 16


# -- sequences -------------------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (digest and number of words of each turn) of the rebuilt conversations."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t")
    )
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_TAKEN)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_TAKEN - 1).alias("head"))
    both = own.withColumns({"base": base, "h": taken}).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, n, hashes, sums``: hash of each prefix, the words up to its end, and the hash of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch.column(1).to_pylist():
                hashes, now = [], _ROOT
                for t in turns:
                    now = hashlib.sha256(now + t["digest"]).digest()[:16]
                    hashes.append(now)
                rows.append((now, len(turns), hashes, np.cumsum([t["words"] for t in turns], dtype=np.int64)))
            key, n, hashes, sums = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(hashes, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))],
                ["conv_id", "key", "n", "hashes", "sums"],
            )

    return small_batches(conversations).mapInArrow(run, "conv_id long, key binary, n int, hashes array<binary>, sums array<long>")


# -- search ----------------------------------------------------------------------------------------------------------


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    lost = F.length(F.bin((low.bitwiseXOR(high)).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, lost), lost)


def _at(depth: Column) -> Column:
    return F.when(depth > 0, F.get("hashes", depth - 1))


def located(batch: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """The sequences with ``exit``, the node in whose edge a sequence leaves the trie, and ``lcp``, the depth of that place.

    Without an edge that goes on like the sequence, ``exit`` is null and ``lcp`` the depth of the deepest node on its way.
    """
    handles = stored(nodes.select(
        F.get("edge", two_fattest(F.col("low"), F.col("high")) - F.col("low") - 1).alias("probe"), F.col("node").alias("hit"), F.col("high").alias("hit_high")
    ))
    at = batch.withColumns({"l": F.lit(0), "r": F.col("n"), "exit": F.lit(None).cast("binary")})
    for step in range(longest.bit_length() + 1):
        searching = F.col("exit").isNull() & (F.col("l") < F.col("r"))
        at = at.withColumn("f", F.when(searching, two_fattest(F.col("l"), F.col("r")))).withColumn("probe", _at(F.col("f")))
        at = join_lookup(at, handles, "probe", "left")
        hit = F.col("hit").isNotNull()
        goes_on = hit & (F.col("hit_high") <= F.col("n")) & _at(F.col("hit_high")).eqNullSafe(F.col("hit"))
        at = at.withColumns({
            "exit": F.when(hit & ~goes_on, F.col("hit")).otherwise(F.col("exit")),
            "l": F.when(goes_on, F.col("hit_high")).otherwise(F.col("l")),
            "r": F.when(F.col("f").isNotNull() & ~hit, F.col("f") - 1).otherwise(F.col("r")),
        }).drop("f", "probe", "hit", "hit_high")
        if step % 4 == 3:
            at = stored(at)
    entries = nodes.select(F.get("edge", F.lit(0)).alias("first"), F.col("node").alias("child"))
    at = at.withColumn("first", F.when(F.col("exit").isNull() & (F.col("l") < F.col("n")), _at(F.col("l") + 1)))
    at = join_lookup(at, stored(entries), "first", "left").withColumn("exit", F.coalesce("exit", "child")).drop("first", "child")
    edges = nodes.select(F.col("node").alias("exit"), "low", "edge")
    at = join_lookup(stored(at), edges, "exit", "left")
    same = F.size(F.filter(F.arrays_zip("edge", F.slice("hashes", F.col("low") + 1, F.size("edge")).alias("own")), lambda z: z["edge"] == z["own"]))
    lcp = F.when(F.col("exit").isNull(), F.col("l")).otherwise(F.col("low") + same)
    return at.withColumn("lcp", lcp.cast("int")).drop("low", "edge", "l", "r")


# -- insertion -------------------------------------------------------------------------------------------------------


def _subtrie(table: pa.Table) -> pa.Table:
    """Compacted nodes of sequences that leave the trie at the same place with the same next turn."""
    seqs = sorted(zip(table["hashes"].to_pylist(), table["sums"].to_pylist()), key=lambda s: s[0])
    out, todo = [], [(seqs, table["lcp"][0].as_py())]
    while todo:
        seqs, low = todo.pop()
        (a, sums), b = seqs[0], seqs[-1][0]
        high = low + 1
        while high < min(len(a), len(b)) and a[high] == b[high]:
            high += 1
        out.append((a[high - 1], a[low - 1] if low else _ROOT, low, high, a[low:high], sums[low - 1] if low else 0, sums[low:high]))
        groups: dict[bytes, list] = {}
        for s in seqs:
            if len(s[0]) > high:
                groups.setdefault(s[0][high], []).append(s)
        todo += [(g, high) for g in groups.values()]
    names = ["node", "parent", "low", "high", "edge", "before", "sums"]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.int64())]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


def _cut(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes cut at the depths ``exit, lcp`` inside their edges."""
    cuts = places.groupBy(F.col("exit").alias("node")).agg(F.collect_set("lcp").alias("cuts"))
    both = nodes.join(cuts, "node", "left")
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("low")) & (c < F.col("high")))
    ends = F.array_sort(F.concat(F.array("low"), inside, F.array("high")))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(F.get(ends, i - 1).alias("low"), F.get(ends, i).alias("high"))
    )
    cut = both.select(*nodes.columns, F.explode(pieces).alias("p"))
    start, end = F.col("p.low") - F.col("low"), F.col("p.high") - F.col("low")
    return cut.select(
        F.get("edge", end - 1).alias("node"), F.when(start == 0, F.col("parent")).otherwise(F.get("edge", start - 1)).alias("parent"),
        F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.slice("edge", start + 1, end - start).alias("edge"),
        F.when(start == 0, F.col("before")).otherwise(F.get("sums", start - 1)).alias("before"), F.slice("sums", start + 1, end - start).alias("sums"),
    )


def inserted(nodes: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """The trie with the sequences of a batch."""
    at = stored(located(batch, nodes, longest))
    new = at.where("lcp < n").withColumn("next", F.get("hashes", F.col("lcp"))).select("next", "lcp", "hashes", "sums")
    grown = new.groupBy("next").applyInArrow(_subtrie, _NODES)
    return stored(_cut(nodes, at.where(F.col("exit").isNotNull()).select("exit", "lcp")).unionByName(grown))


def built(sequences: DataFrame, first_batch: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """Compacted nodes of distinct sequences ``key, n, hashes, sums``, but for the root."""
    nodes = sequences.sparkSession.createDataFrame([], _NODES)
    total, longest = sequences.agg(F.count("*"), F.max("n")).first()
    slot, done, upto = F.pmod(F.xxhash64("key"), F.lit(_SLOTS)), 0, first_batch
    while total and done < _SLOTS:
        last = _SLOTS if upto >= total else _SLOTS * upto // total
        nodes = inserted(nodes, sequences.where((slot >= done) & (slot < last) & (F.col("n") > 0)), longest)
        done, upto = last, upto * growth
    return nodes


# -- figures ---------------------------------------------------------------------------------------------------------


def paths(nodes: DataFrame) -> DataFrame:
    """``node, path``: the nodes above each node, the nearest first and the root last, found by doubling."""
    root = F.lit(_ROOT)
    now = stored(nodes.select("node", F.array("parent").alias("path")))
    last = F.element_at("path", -1)
    while not now.where(last != root).isEmpty():
        further = now.select(F.col("node").alias("last"), F.col("path").alias("further"))
        longer = join_lookup(now.withColumn("last", F.when(last != root, last)), further, "last", "left")
        now = stored(longer.select("node", F.concat("path", F.coalesce("further", F.slice("path", 1, 0))).alias("path")))
    return now


def digests(members: DataFrame) -> DataFrame:
    """``key, ends_sha256``: digest of the ascending ids of each key, joined by commas.

    Ids are range-partitioned and joined to pieces in parallel; only these pieces meet, in order, in a digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, n = None, [], 0
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) >= _CHUNK):
                    yield pa.record_batch([[key], [n], [ids[0]], [",".join(map(str, ids))]], ["key", "n", "first", "ids"])
                    ids, n = [], n + 1
                key = k
                ids.append(i)
        if ids:
            yield pa.record_batch([[key], [n], [ids[0]], [",".join(map(str, ids))]], ["key", "n", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if digest:
                        yield pa.record_batch([[key], [digest.hexdigest()]], ["key", "ends_sha256"])
                    key, digest = k, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
        if digest:
            yield pa.record_batch([[key], [digest.hexdigest()]], ["key", "ends_sha256"])

    ranged = small_batches(members.select("key", "conv_id")).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = ranged.mapInArrow(pieces, "key binary, n long, first long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first", "n").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, first_batch: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Turns are ordered by ``turn``, null first, and turns of equal number by the digest of role and text; repeated rows
    are turns of their own. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and take
    no part. A conversation's group starts at ``conv_id - conv_id % 20``, with the sign of SQL's remainder. Without any
    conversation there are no nodes, not even a root. Other columns are ignored. Of a turn its digest and word count are
    kept, 24 bytes, and a conversation is one row of these.
    """
    convs = stored(prefixes(rebuilt(conversations.select("conv_id", "turn", "role", "text"))))
    groups = stored(convs.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("least")))
    sequences = stored(convs.join(groups.select(F.col("least").alias("conv_id")), "conv_id", "left_semi").drop("conv_id"))
    nodes = built(sequences, first_batch, growth)

    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    root = conversations.sparkSession.createDataFrame([(_ROOT, None, 0, 0, [], 0, [])], _NODES)
    all_nodes = nodes.withColumn("parent", F.col("parent")).unionByName(root)
    ways = paths(nodes).unionByName(root.select("node", F.array().cast("array<binary>").alias("path")))
    ends = groups.join(digests(convs), "key").withColumnRenamed("key", "node")
    known = all_nodes.join(ways, "node").join(kids, "node", "left").join(ends, "node", "left")
    known = stored(known.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    ancestors = known.select(
        F.explode(F.concat(F.array("node"), "path")).alias("node"), "weight", "least", (F.col("n_children") == 0).cast("long").alias("leaf")
    )
    figures = ancestors.groupBy("node").agg(F.sum("weight").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    known = stored(known.join(figures, "node"))
    spared = (F.col("n_convs") - 1) * (F.get("sums", F.size("sums") - 1) - F.col("before"))
    below = known.where("high > 0").select(F.explode("path").alias("node"), spared.alias("s")).groupBy("node").agg(F.sum("s").alias("below"))
    above = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("above_conv_id"))
    whole = join_lookup(known.join(below, "node", "left"), stored(above), "parent", "left")
    whole = whole.withColumn("below", F.coalesce("below", F.lit(0).cast("long")))

    # each depth of an edge, with the words before it; the root is a depth of its own
    starts = F.concat(F.array("before"), F.slice("sums", F.lit(1), F.greatest(F.size("sums") - 1, F.lit(0))))
    words = F.coalesce(F.get("sums", F.size("sums") - 1), F.col("before"))
    steps = whole.withColumn("words", words).select("*", F.posexplode(starts).alias("i", "start"))
    depth = F.when(F.col("high") == 0, 0).otherwise(F.col("low") + 1 + F.col("i")).cast("long")
    last, none = depth == F.col("high"), hashlib.sha256(b"").hexdigest()
    return steps.where("n_convs is not null").select(
        "conv_id", depth.alias("depth"),
        F.when(F.col("i") == 0, F.col("above_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("words") - F.col("start"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"),
    )
