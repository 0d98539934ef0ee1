"""Which windows of L symbols start more than once in a corpus, found by naming fewer and fewer substrings.

*Cover.* Each window of L symbols is owned by the place of its least k-gram hash (the first one of a tie). The place
depends on the window's own symbols alone, so equal windows are owned by places at the same offset: the sampled places
cover every pair of equal windows, as a difference cover does by arithmetic, with about 2 / (L - k + 2) of all places.

*Names.* The windows of an owner are dealt into ranges by their distance to it. Two strings belong to a range: the
symbols that all its windows share (``inner``) and those that any of them holds (``outer``). If ``inner`` occurs once,
no window of the range recurs; if ``outer`` occurs twice, all do. Else the range is cut into shorter ones, down to
single windows, which are counted exactly.

Between passes travel only counts of 64-bit names and bit filters of fixed size. A filter can err on one side only; it
is always asked so that an error sends a range on to the next pass, never to a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import Prefixes, _sliding, filter_of, may_hold, mixed, small_batches, utf8
from opslens.session import stored

#: Bytes of short texts that are looked at together, and windows of a longer text: where a text is cut depends on the
#: text alone, so every pass cuts it alike.
SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_ALL = np.uint64(2**64 - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_symbols(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins; the end comes last."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between the six ASCII white-space characters."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by a space, starts and ends of the words in it, and the first word of each text; the end comes last."""
    data = b" ".join(texts)
    starts, ends = word_bounds(data)
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)])
    return data, starts, ends, np.searchsorted(starts, begin)


def word_symbols(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the first word of each text; the end comes last."""
    data, starts, ends, bounds = words_of(texts)
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # by pieces of whole words, so that no array is much longer than a segment
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        low, high = starts[at], ends[upto - 1]
        raw = np.frombuffer(data, np.uint8)[low:high]
        out[at:upto] = Prefixes(_BYTES[raw]).hashes(starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out, bounds


@dataclass(frozen=True)
class Kind:
    """What is searched: windows of ``length`` symbols, owned through ``gram`` symbols; range sizes, each a multiple of the next."""

    symbols: Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int
    sizes: tuple[int, ...]


@dataclass
class Ranges:
    """Ranges of windows: number of the text, first and last window in it, and the names of both strings."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def tokens(self, names: np.ndarray) -> np.ndarray:
        return mixed(mixed(self.low.astype(np.uint64)) ^ names[self.text].view(np.uint64))

    def take(self, which: np.ndarray) -> Ranges:
        return Ranges(self.text[which], self.low[which], self.high[which], self.inner[which], self.outer[which])


@dataclass
class Level:
    """Filters of a pass: names of single ``outer`` strings, of repeated ``inner`` ones, and tokens of one range for
    each repeated ``outer`` whose ``inner`` a single one shares.

    A repeated ``outer`` that the first filter holds by chance goes on with all its copies, as its ``inner`` is repeated.
    """

    once: np.ndarray
    shared: np.ndarray
    chosen: np.ndarray


@dataclass
class Known:
    """What the passes so far have found."""

    owners: np.ndarray | None = None
    levels: list[Level] = field(default_factory=list)

    def arrays(self) -> tuple:
        """The filters alone, to be broadcast."""
        return self.owners, [(x.once, x.shared, x.chosen) for x in self.levels]

    @staticmethod
    def of(arrays: tuple) -> Known:
        return Known(arrays[0], [Level(*x) for x in arrays[1]])


@dataclass
class Owned:
    """The owners of one segment: text, where the text's first symbol would be in the segment, first and last window,
    place and name of each, all places counted from the segment's start."""

    sums: Prefixes
    text: np.ndarray
    origin: np.ndarray
    low: np.ndarray
    high: np.ndarray
    place: np.ndarray
    name: np.ndarray

    def take(self, which: np.ndarray) -> Owned:
        return Owned(self.sums, self.text[which], self.origin[which], self.low[which], self.high[which], self.place[which], self.name[which])

    def cut(self, kind: Kind, size: int) -> tuple[Ranges, Owned]:
        """The ranges of ``size`` windows of each owner, as ranges of their texts and as owners of fewer windows."""
        first, last = (self.place - self.high) // size, (self.place - self.low) // size
        count = last - first + 1
        owner = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        parts = self.take(owner)
        top = parts.place - size * number
        parts.low, parts.high = np.maximum(parts.low, top - size + 1), np.minimum(parts.high, top)
        inner, outer = self.sums.hashes(top, top - size + 1 + kind.length), self.sums.hashes(parts.low, parts.high + kind.length)
        return Ranges(parts.text, parts.low - parts.origin, parts.high - parts.origin, inner, outer), parts


def packs(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts of ``SEGMENT`` bytes at most; a longer text is a slice of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > SEGMENT:
            yield first, i
            first, size = i, 0
        size += len(text)
    if len(texts) > first:
        yield first, len(texts)


def segments(kind: Kind, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[Owned]:
    """The owners of all windows that lie within one text. The symbols are those of a slice of ``packs``."""
    width = kind.length - kind.gram + 1
    text_of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for start in range(0, len(symbols) - kind.length + 1, SEGMENT):
        part = symbols[start : start + SEGMENT + kind.length - 1]
        sums = Prefixes(_BYTES[part] if part.dtype == np.uint8 else part)
        grams = len(part) - kind.gram + 1
        h = (sums.sums[kind.gram :] - sums.sums[:grams]) * Prefixes._inverse[:grams]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        key = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        least = _sliding(key, width, np.minimum, _ALL)
        text = text_of[start : start + len(least)]
        whole = np.arange(start + kind.length, start + kind.length + len(least)) <= bounds[text + 1]
        low = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])]))
        high = np.concatenate([low[1:], [len(least)]]) - 1
        low, high = low[whole[low]], high[whole[low]]
        place = (least[low] & _PLACE).astype(np.int64)
        yield Owned(sums, text[low], bounds[text[low]] - start, low, high, place, h[place])


def decide(kind: Kind, symbols: np.ndarray, bounds: np.ndarray, names: np.ndarray, known: Known) -> Iterator[tuple[Owned, list[Ranges], Ranges | None]]:
    """For every segment its owners that may recur, the ranges known to recur (a list by pass), and those that the next
    pass must look at, cut to its size.

    The latter are undecided, or stand for all copies of a range that recurs, because their windows may also recur
    where the whole range does not.
    """
    for owned in segments(kind, symbols, bounds):
        if known.owners is None:
            yield owned, [], None
            continue
        owned = now = owned.take(may_hold(known.owners, owned.name))
        sure: list[Ranges] = []
        for size, level in zip(kind.sizes, known.levels):
            ranges, parts = now.cut(kind, size)
            single = may_hold(level.once, ranges.outer)
            sure.append(ranges.take(~single))
            going = np.where(single, may_hold(level.shared, ranges.inner), may_hold(level.chosen, ranges.tokens(names)))
            now = parts.take(going)
        ask, _ = now.cut(kind, kind.sizes[len(known.levels)] if len(known.levels) < len(kind.sizes) else 1)
        yield owned, sure, ask


def _scan(rows: DataFrame, kind: Kind, known: Known, schema: str, make: Callable, reduce: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What ``reduce`` makes of a pass, stored. ``make(names, owned, sure, ask)`` gives arrays for every segment of ``name, text`` rows."""
    sent = rows.sparkSession.sparkContext.broadcast(known.arrays())
    columns = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known.of(sent.value)
        for batch in batches:
            names, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for first, last in packs(texts):
                own = names[first:last]
                for owned, sure, ask in decide(kind, *kind.symbols(texts[first:last]), own, known):
                    made = [x.view(np.int64) for x in make(own, owned, sure, ask)]
                    if len(made[0]):
                        yield pa.record_batch([pa.array(x) for x in made], columns)

    done = stored(reduce(small_batches(rows).mapInArrow(run, schema)))
    sent.destroy()
    return done


@dataclass
class Found:
    """What a search has stored: ``h, n``, the owners that occur twice; for each pass ``i, o, n, t``, its ranges with their
    counts and one token; ``h, name, at, t``, the single windows that recur beyond the ranges."""

    known: Known
    owners: DataFrame
    passes: list[DataFrame]
    single: DataFrame


def search(rows: DataFrame, kind: Kind) -> Found:
    """Which windows of ``name long, text`` rows recur. ``name`` tells rows apart; rows of equal name must have equal text."""
    twice = lambda df: df.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    owners = _scan(rows, kind, Known(), "h long", lambda names, owned, sure, ask: [owned.name], twice)
    known = Known(filter_of(owners, "h"))
    passes: list[DataFrame] = []
    for _ in kind.sizes:
        outer = _scan(
            rows, kind, known, "i long, o long, t long", lambda names, owned, sure, ask: [ask.inner, ask.outer, ask.tokens(names)],
            lambda df: df.groupBy("i", "o").agg(F.count("*").alias("n"), F.min("t").alias("t")),
        )
        inner = stored(outer.groupBy("i").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1"))
        chosen = stored(outer.where("n > 1").join(inner.where("least = 1"), "i", "left_semi").select("t"))
        level = Level(filter_of(outer.where("n = 1"), "o"), filter_of(inner, "i"), filter_of(chosen, "t"))
        known = Known(known.owners, [*known.levels, level])
        passes.append(outer)
    single = _scan(
        rows, kind, known, "h long, name long, at long, t long",
        lambda names, owned, sure, ask: [ask.outer, names[ask.text], ask.low, ask.tokens(names)],
    )
    return Found(known, owners, passes, stored(single.join(twice(single), "h", "left_semi")))


def sure_windows(kind: Kind, symbols: np.ndarray, bounds: np.ndarray, names: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows, as places in ``symbols``, of the ranges that are known to recur."""
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, sure, _ in decide(kind, symbols, bounds, names, known):
        low += [bounds[x.text] + x.low for x in sure]
        high += [bounds[x.text] + x.high for x in sure]
    return np.concatenate(low), np.concatenate(high)


def covered(n: int, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts between ``low`` and ``high``."""
    step = np.bincount(low, minlength=n + 1) - np.bincount(high + length, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
