"""Probabilistic suffix tree over words: contexts of varying length, kept where they change what follows.

*Tokens.* The words of a text, A-Z lower-cased, then one end. N tokens are learned from, V of them distinct.

*Counts.* Every word is counted, and every longer n-gram whose two shorter parts are frequent; frequent is what occurs
``LEAST_COUNT`` times in the training texts. No share of the corpus is asked for unless a caller sets ``least_share``.
Words and n-grams are known by hashes of 64 bits.

*Divergence.* A frequent n-gram s is a context if the tokens after it are better told by their own counts than by the
distribution of s without its first word: the gain in log-likelihood over all its occurrences must pay half a ln N for
each successor listed and one for the rest (description length). Contexts grow from kept ones, so that every suffix of a
context is one.

*Smoothing.* A listed successor has (c - 0.5) / c(s); what is left goes to all others in proportion to the distribution
one word shorter. The root has (c + 1) / (N + V + 1), one share for unseen words. Every distribution adds up to one.

*Scores.* A token is told by the longest context before it.

*Exchange.* Texts are dealt into blocks, names into buckets. In each step a block asks for the names that it holds, once
each however often they occur there, and gets their counts, or whether they are contexts; so no task gets more
than a block, or a bucket, and no table of n-grams comes to the driver. Of the blocks that hold an n-gram one owns it and
brings it to the sums of its context, as a single figure for all successors that the block owns. Names are sent as sorted,
compressed lists; answers follow their order and need no names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opslens.llm.support import mixed, small_batches
from opslens.session import stored

#: Least share of the training tokens, and least count, of a frequent n-gram; most words of a context.
LEAST_SHARE, LEAST_COUNT, DEPTH = 0.0, 2, 3
DISCOUNT = 0.5
#: Text of a block, whose words are counted together, and of a bucket, whose names are counted in one task.
BLOCK_BYTES, BUCKET_BYTES = 8 * 1024**2, 16 * 1024**2
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is not learned from; a row without an id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


# -- tokens of a block -----------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Texts' tokens one after the other: number of each in ``names`` (hashes of the distinct words, the end first),
    the first token of each text and the end of the last one, and which texts are learned from."""

    tokens: np.ndarray
    names: np.ndarray
    bounds: np.ndarray
    learned: np.ndarray

    def mask(self) -> np.ndarray:
        return np.repeat(self.learned, np.diff(self.bounds))


def hashes(words: pa.Array) -> Iterator[int]:
    """A hash of each word, taken from the array's own bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data, digest = words.buffers()[2].to_pybytes() if len(words) else b"", xxhash.xxh64_intdigest
    return (digest(data[a:b], 12) for a, b in zip(ends, ends[1:]))


def block_of(texts: pa.Array, learned: pa.Array) -> Block:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    per_text = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
    coded = words.filter(pa.array(full)).dictionary_encode()
    # an end hashes to 0, which no word of the corpus is likely to do
    names = np.array([0, *hashes(coded.dictionary)], np.uint64)
    bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
    tokens = np.zeros(bounds[-1], np.int64)
    word = np.ones(bounds[-1], bool)
    word[bounds[1:] - 1] = False
    tokens[word] = coded.indices.to_numpy().astype(np.int64) + 1
    return Block(tokens, names, bounds, np.array(learned.to_pylist(), bool))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Block]]:
    """Batches ``text, learned, ...`` joined up to ``BLOCK_BYTES`` of text, and their tokens."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size + batch.nbytes > BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, block_of(table["text"].chunk(0), table["learned"].chunk(0))
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, block_of(table["text"].chunk(0), table["learned"].chunk(0))


# -- lists of numbers ------------------------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte by byte of all of them, compressed; small numbers take little room. Bytes that are
    0 in all of them are left out."""
    own = np.ascontiguousarray(values, "<u8")
    width = (int(own.max(initial=0)).bit_length() + 7) // 8
    planes = b"".join(own.view(np.uint8)[i::8].tobytes() for i in range(width))
    return len(own).to_bytes(4, "little") + bytes([width]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(pa.decompress(memoryview(data)[5:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    for i in range(width):
        out[:, i] = planes[i * n : (i + 1) * n]
    return out.reshape(-1).view("<u8")


def packed_names(names: np.ndarray) -> bytes:
    """Names that mostly ascend as their differences, modulo 2**64."""
    return packed(np.diff(names, prepend=np.uint64(0)))


def unpacked_names(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def dealt(names: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """For each bucket with names, which slice of the ascending names it gets: its range of their upper halves."""
    own = (names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1)))
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
        yield int(own[low]), low, high


# -- blocks ----------------------------------------------------------------------------------------------------------

_STATE = "block long, ids array<{id}>, learned array<boolean>, tokens binary, names binary, sizes binary, n long"
#: Kind k: n-grams of k tokens and their training occurrences in a block. Kind -k: contexts of k tokens, and of each its
#: count, then of its successors that the block owns number, counts, gain and probability one word shorter. The count is sent
#: with successors only, and the gain with several: that of one follows from the others.
_ASKED = "block long, kind int, bucket int, names binary, figures binary"
#: Kind k: twice the count, and 1 for the block that owns the n-gram. Kind -k: log10 of the factor for tokens that are not
#: listed, NaN if it is no context. ``v``: distinct words of the bucket, on one of its rows.
_ANSWERED = "block long, kind int, bucket int, figures binary, v long"
_SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def blocks(docs: DataFrame) -> DataFrame:
    """The tokens of the rows ``doc_id, text, learned``, a row for each block."""
    schema = _STATE.format(id=docs.schema["doc_id"].dataType.simpleString())
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (table, block) in enumerate(blocks_of(batches)):
            order, _ = ranked(block.names)  # small numbers for frequent words, and ascending names where words are as frequent
            order = order[np.argsort(-np.bincount(block.tokens)[order], kind="stable")]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row = {
                "block": part << 32 | i, "ids": table["doc_id"].chunk(0), "learned": block.learned, "tokens": packed(rank[block.tokens]),
                "names": packed_names(block.names[order]), "sizes": packed(np.diff(block.bounds)), "n": int(block.mask().sum()),
            }
            yield pa.record_batch([pa.array([row[f.name]], f.type) for f in fields], schema=fields)

    return small_batches(docs).mapInArrow(run, schema)


def restored(row: dict) -> Block:
    bounds = np.concatenate([[0], np.cumsum(unpacked(row["sizes"]).astype(np.int64))])
    return Block(unpacked(row["tokens"]).astype(np.int64), unpacked_names(row["names"]), bounds, np.array(row["learned"], bool))


def ranked(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the names, equal ones by place, and the names in it."""
    bits = np.uint64(len(names).bit_length())
    # numbers are sorted in less time than places: the lowest bits of a name give way to its place
    order = np.sort(names >> bits << bits | np.arange(len(names), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    now = names[order.view(np.int64)]
    if (now[1:] < now[:-1]).any():  # names that differ in these bits only
        order = np.argsort(names, kind="stable")
        now = names[order]
    return order.view(np.int64), now


@dataclass
class Grams:
    """N-grams of a block by length: ``names[k]``, ascending, of those of k + 1 tokens, ``counts[k]`` and ``owned[k]``, ``at[k]``
    the place among them of the one that ends at each token (-1: not asked for), ``first[k]`` the first token that each ends
    at (of single tokens: none).

    ``kept[k]``, ``rest[k]``: whether it is a context, and the log10 factor of tokens not listed after it. ``base``: log10
    probability of each token by counts of words, ``score``: by the contexts known so far.
    """

    at: list[np.ndarray] = field(default_factory=list)
    names: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    owned: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    base: np.ndarray | None = None
    score: np.ndarray | None = None

    def add(self, n: int, which: np.ndarray, names: np.ndarray) -> None:
        """N-grams of one more token, that end at the tokens ``which`` of ``n``: the name of each token's."""
        order, names = ranked(names)
        new = np.diff(names, prepend=names[:1] ^ np.uint64(1)) != 0
        ends = which[order]
        at = np.full(n, -1, np.int32)
        at[ends] = np.cumsum(new, dtype=np.int32) - 1
        self.at.append(at)
        self.names.append(names[new])
        self.first.append(ends[new])


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]``, and 0 where the place is -1."""
    return np.append(values, np.zeros(1, values.dtype))[at]


def after(block: Block, here: np.ndarray) -> np.ndarray:
    """For each token whether the one before it in its text is one of ``here``."""
    out = np.concatenate([[False], here[:-1]])
    out[block.bounds[:-1]] = False
    return out


def grams_of(block: Block, answers: dict[int, np.ndarray], upto: int, depth: int, floor: int, total: int, scored: bool) -> Grams:
    """The n-grams of up to ``upto`` tokens, with what the answers tell of them and, if ``scored``, of the tokens. The longest
    ones are no contexts, and are taken only where the context before them may be one."""
    grams, n = Grams(), len(block.tokens)
    words = named = block.names[block.tokens]
    for k in range(upto):
        if not k:
            names, place = np.unique(block.names, return_inverse=True)
            grams.at.append(place.astype(np.int32)[block.tokens])
            grams.names.append(names)
            grams.first.append(np.zeros(0, np.int64))
        else:
            now = may = picked(grams.counts[k - 1] >= floor, grams.at[k - 1])
            if k == depth:
                may = picked(candidates(grams, k, floor), grams.at[k - 1])
            which = np.flatnonzero(now & after(block, may))
            longer = mixed(named[which - 1] * _GRAM + words[which])
            grams.add(n, which, longer)
            named = np.empty(n, np.uint64)  # only these are looked at
            named[which] = longer
        if k + 1 in answers:
            grams.counts.append((answers[k + 1] >> np.uint64(1)).astype(np.int64))
            grams.owned.append((answers[k + 1] & np.uint64(1)).astype(bool))
        if not k and scored:
            grams.base = np.log10((grams.counts[0] + 1.0) / total)[grams.at[0]]
            grams.score = grams.base.copy()
        if -k in answers:
            apply(block, grams, k, answers[-k], floor)
    return grams


def candidates(grams: Grams, k: int, floor: int) -> np.ndarray:
    """Which n-grams of k tokens may be contexts: the frequent ones whose suffix is one."""
    many = grams.counts[k - 1] >= floor
    if k > 1:
        many &= picked(grams.kept[k - 2], grams.at[k - 2][grams.first[k - 1]])
    return many


def apply(block: Block, grams: Grams, k: int, answer: np.ndarray, floor: int) -> None:
    """Tells which n-grams of k tokens are contexts, and lets them tell what follows them if there are scores."""
    rest = np.full(len(grams.names[k - 1]), np.nan)
    rest[candidates(grams, k, floor)] = answer.view(np.float64)
    grams.kept.append(~np.isnan(rest))
    grams.rest.append(rest)
    if grams.score is None:
        return
    state = np.flatnonzero(after(block, picked(grams.kept[-1], grams.at[k - 1])))
    context, longer = grams.at[k - 1][state - 1], grams.at[k][state]
    count = picked(grams.counts[k], longer)
    listed = count >= floor
    grams.score[state[~listed]] += rest[context[~listed]]
    grams.score[state[listed]] = np.log10((count[listed] - DISCOUNT) / grams.counts[k - 1][context[listed]])


def successors(block: Block, grams: Grams, k: int, floor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names of the contexts of k tokens that are asked for, and the figures of each."""
    asked = candidates(grams, k, floor)
    context = grams.at[k - 1][grams.first[k] - 1]
    own = np.flatnonzero(grams.owned[k] & (grams.counts[k] >= floor) & asked[context])
    context, count, short = context[own], grams.counts[k][own].astype(float), 10.0 ** grams.score[grams.first[k][own]]
    gain = count * np.log((count - DISCOUNT) / grams.counts[k - 1][context] / short)
    summed = lambda *x: np.bincount(context, *x, minlength=len(asked))[asked]
    listed, gain = summed(), summed(gain)
    gain[listed == 1] = 0
    numbers = [np.where(listed > 0, grams.counts[k - 1][asked], 0), listed, summed(count)]
    return grams.names[k - 1][asked], [*(x.astype(np.uint64) for x in numbers), *(x.view(np.uint64) for x in (gain, summed(short)))]


def steps(depth: int) -> list[list[int]]:
    """What is asked for one after the other, by kind: contexts wait for the counts of what follows them and for the contexts
    one word shorter, the longest n-grams for the contexts that they may be listed by."""
    return [*([k, 2 - k][: 1 + (k > 2)] for k in range(1, depth + 1)), *[[1 - depth]] * (depth > 1), [depth + 1], [-depth]]


def asked(row: dict, answers: dict[int, np.ndarray], kinds: list[int], depth: int, buckets: int, floor: int, total: int) -> pa.Table:
    """What a block asks for in a step."""
    block = restored(row)
    grams = grams_of(block, answers, max(0, *answers, *kinds), depth, floor, total, min(kinds) < 0)
    mask, wanted = block.mask(), []
    for kind in kinds:
        if kind > 0:
            at = grams.at[kind - 1]
            learned = np.bincount(at[mask & (at >= 0)], minlength=len(grams.names[kind - 1]))
            wanted.append((kind, grams.names[kind - 1], [learned.astype(np.uint64)]))
        else:
            wanted.append((kind, *successors(block, grams, -kind, floor)))
    rows = [
        (row["block"], kind, bucket, packed_names(names[a:b]), packed(np.concatenate([x[a:b] for x in figures])))
        for kind, names, figures in wanted for bucket, a, b in dealt(names, buckets)
    ]
    kinds = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "names": pa.binary(), "figures": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


# -- buckets ---------------------------------------------------------------------------------------------------------


def answered(table: pa.Table, floor: int, n: int) -> pa.Table:
    """What the blocks that ask a bucket are told."""
    table = table.select(["block", "kind", "bucket", "names", "figures"]).sort_by("block")
    kind = table["kind"][0].as_py()
    lists = [unpacked_names(x) for x in table["names"].to_pylist()]
    rows = np.concatenate([unpacked(x).reshape(-1, len(own)) for x, own in zip(table["figures"].to_pylist(), lists)], axis=1)
    names = np.concatenate(lists)
    order = np.argsort(names, kind="stable")
    new = np.diff(names[order], prepend=names[order[:1]] ^ np.uint64(1)) != 0
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    words = 0
    if kind > 0:
        count = np.add.reduceat(rows[0][order], first)
        words = int((count > 0).sum())
        # a word's count matters however small it is
        matters = (count >= floor) | (kind == 1)
        told = (np.where(matters, count, 0) * np.uint64(2))[group] + (new & matters[group])
    else:
        number, count, gain, short = rows[1], rows[2].astype(float), rows[3].view(np.float64), rows[4].view(np.float64)
        context = np.maximum.reduceat(rows[0][order], first).astype(float)
        one = number == 1
        gain[one] = count[one] * np.log((count[one] - DISCOUNT) / rows[0][one] / short[one])
        listed, counts, gain, short = (np.add.reduceat(x[order], first) for x in (number.astype(float), count, gain, short))
        context = np.maximum(context, 1)  # without a listed successor it is not sent, and it is no context
        left, short_left = np.maximum((context - counts + DISCOUNT * listed) / context, 1e-12), np.maximum(1 - short, 1e-12)
        gain += (context - counts) * np.log(left / short_left)
        kept = (listed > 0) & (gain > 0.5 * (listed + 1) * np.log(max(n, 2)))
        told = np.where(kept, np.log10(left / short_left), np.nan)[group].view(np.uint64)
    out = np.empty(len(names), np.uint64)
    out[order] = told
    cuts = np.cumsum([0, *map(len, lists)])
    figures = pa.array([packed(out[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
    v = pa.array([words if kind == 1 else 0] + [0] * (len(lists) - 1), pa.int64())
    return pa.table({"block": table["block"], "kind": table["kind"], "bucket": table["bucket"], "figures": figures, "v": v})


# -- steps -----------------------------------------------------------------------------------------------------------


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has Spark remove the shuffle files of a step when its result is stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def told(table: pa.Table, kinds: list[int]) -> tuple[dict, dict[int, np.ndarray]]:
    """A block's own row, and the answers that it got by their kind, in the order of the names asked for."""
    own = table.filter(pc.is_null(table["kind"])).select(["block", "ids", "learned", "tokens", "names", "sizes"]).to_pylist()[0]
    rows = table.filter(pc.is_valid(table["kind"])).select(["kind", "bucket", "figures"]).sort_by([("kind", "ascending"), ("bucket", "ascending")]).to_pylist()
    by: dict[int, list[np.ndarray]] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(unpacked(r["figures"]))
    return own, {k: np.concatenate(by[k]) if k in by else np.zeros(0, np.uint64) for k in kinds}


def finished(row: dict, answers: dict[int, np.ndarray], depth: int, floor: int, n: int, total: int, kind: pa.DataType) -> pa.Table:
    """The scores of a block's texts."""
    block = restored(row)
    grams = grams_of(block, answers, depth + 1, depth, floor, total, True)
    per_text = partial(np.add.reduceat, indices=block.bounds[:-1])
    return pa.table({
        "doc_id": pa.array(row["ids"], kind), "held_out": ~block.learned, "n_tokens": np.diff(block.bounds),
        "n_known": per_text((grams.counts[0] > 0)[grams.at[0]].astype(np.int64)), "train_tokens": np.full(len(block.learned), n),
        "base_score": per_text(grams.base), "score": per_text(grams.score),
    })


def score(docs: DataFrame, buckets: int, least_share: float, least_count: int, depth: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for the rows ``doc_id, text, learned``."""
    spark = docs.sparkSession
    state = stored(blocks(docs))
    n = state.agg(F.sum("n")).first()[0] or 0
    floor, total = max(least_count, int(np.ceil(least_share * n))), 0
    answers: list[DataFrame] = []
    known: list[int] = []

    def with_answers() -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers, state.drop("n")).groupBy("block")

    def asking(kinds: list[int], known: list[int], total: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: asked(*told(table, known), kinds, depth, buckets, floor, total)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from asked(row, {}, [1], depth, buckets, floor, 0).to_batches()

    for kinds in steps(depth):
        requests = with_answers().applyInArrow(asking(kinds, known, total), _ASKED) if answers else small_batches(state).mapInArrow(ask_words, _ASKED)
        with shuffles_removed(spark):
            told_now = stored(requests.groupBy("kind", "bucket").applyInArrow(lambda table: answered(table, floor, n), _ANSWERED))
        if not answers:
            total = n + (told_now.agg(F.sum("v")).first()[0] or 0) + 1
        answers.append(told_now.drop("v"))
        known = known + kinds

    schema = _SCORES.format(id=docs.schema["doc_id"].dataType.simpleString())
    kind = to_arrow_schema(StructType.fromDDL(schema)).field("doc_id").type

    return with_answers().applyInArrow(lambda table: finished(*told(table, known), depth, floor, n, total, kind), schema)


def score_documents(
    docs: DataFrame, learned: Column | None = None, least_share: float = LEAST_SHARE, least_count: int = LEAST_COUNT,
    depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Log10 probabilities of all whole texts, by word counts (``base_score``) and by the tree (``score``).

    ``learned`` says which rows are learned from (by default those that are not held out). A null text is empty: its
    only token is the end. ``n_known`` counts tokens that occur in training texts. Repeated rows are learned from and
    scored as often as they occur; with nothing to learn from every token is unseen. An empty table has no scores.
    Other columns are ignored. A text is held whole in a task.
    """
    learned = ~held_out(id_col) if learned is None else learned
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), learned.alias("learned"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    return score(rows, buckets, least_share, least_count, depth)
