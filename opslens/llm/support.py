"""Reading, settings, bounded bit filters and graph components shared by the operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import stored

#: Rows and bytes that one Arrow batch may hold; a longer text has a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 * 1024**2


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session, because texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def per_batch(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """A frame made batch by batch, with nothing kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return small_batches(df).mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# -- bit filters -----------------------------------------------------------------------------------------------------

#: Most bits of a filter. It bounds what is broadcast, whatever the input; a fuller filter only lets more through.
FILTER_BITS = 1 << 27


def filter_of(df: DataFrame, column: str, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter (two probes, 16 bits for each row up to the bound) of a long column of a stored frame, as words of 64 bits.

    A hash that is in the column is always found; another one is found by chance. The words are joined on the
    executors, so that the driver receives at most one row for each of them.
    """
    bits = min(most_bits, max(1 << 16, 1 << (16 * df.count() - 1).bit_length()))
    h = F.col(column)
    probes = F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))
    found = (
        df.where(h.isNotNull()).select(F.explode(probes).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each uint64 hash whether the filter may hold it; False is certain."""
    bits = np.uint64(len(words) * 64)
    found = np.ones(len(hashes), bool)
    for place in (hashes % bits, (hashes >> np.uint64(32)) % bits):
        found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return found


# -- hashes of substrings --------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ALL = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 values."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of any substring of a symbol sequence (uint64), each from two prefix sums of a polynomial modulo 2**64.

    Symbols are mixed to 64 bits first, so that short or regular texts do not meet the weak places of the modulus.
    """

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Prefixes._powers) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            Prefixes._powers, Prefixes._inverse = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
                for base in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * Prefixes._powers[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Prefixes._inverse[start] + (end - start).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """Least or greatest value of every window, by running extremes of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def local_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width``: every window has one, and equal windows have theirs
    at equal places. All places of a tie are taken."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = np.zeros(len(hashes) + width - 1, np.uint64)
    least[width - 1 : len(hashes)] = _sliding(hashes, width, np.minimum, _ALL)
    return np.flatnonzero(_sliding(least, width, np.maximum, np.uint64(0)) == hashes)


# -- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of edges ``a, b`` (longs), the component being its least node.

    Large-star and small-star steps: in turn every node links its larger neighbours, then its smaller ones, to the
    least node it knows, until nothing changes. Each step is a few shuffles of the edges and is stored, so that a
    lost executor costs one step.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = stored(now.distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


# -- bounded samples and worker state --------------------------------------------------------------------------------


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """``rows`` rows at most, chosen by the hash of their id; only the ids are read to find the limit of the hash."""
    h = F.xxhash64(F.col(id_col))
    last = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)).limit(rows) if last is not None else df.limit(0)


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that later tasks of the same Python worker find again: a loaded tokenizer, a bounded cache.

    Functions that travel with the job have no module of their own in the worker, so ``sys`` keeps it.
    """
    store = sys.__dict__.setdefault("_opslens_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


class Recent(dict):
    """A cache of two generations, each bounded by ``limit`` entries: what is used again outlives what is not.

    Callers look up and update the younger one as a plain dictionary, after ``admit`` has moved to it what they need.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def admit(self, needed: set) -> set:
        """Makes the known ones of ``needed`` ready for look-up, and returns those that are not known."""
        fresh = needed.difference(self)
        if fresh and len(self) + len(fresh) > self.limit:
            self.older = dict(self)
            self.clear()
            fresh = needed
        older = self.older
        if older and fresh:
            again = {k: older[k] for k in fresh if k in older}
            self.update(again)
            fresh = fresh.difference(again)
        return fresh

    def rest(self) -> None:
        """Keeps the younger generation only; the worker may go on to other work."""
        self.older = {}
