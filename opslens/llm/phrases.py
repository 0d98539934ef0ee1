"""Removal of recurring passages by phrase automata.

1. Confirm: ``repeats.search`` finds which windows of words recur. Each recurring range of windows (and each recurring
   single window beyond them) gives one passage, taken from one of its occurrences.
2. Compile: passages are dealt into shards of bounded size by the name of their owner, the least word k-gram of their
   windows; each shard becomes an Aho-Corasick automaton over words.
3. Stream: every stretch of a document whose owner is known goes to the shard of that owner, where the automaton finds
   all occurrences of its passages. A passage counts only if it is found twice: this compares words, not hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.repeats import Found, Kind, Known, covered, decide, packs, search, word_symbols, words_of
from opslens.llm.suffix import named
from opslens.llm.support import filter_of, may_hold, small_batches, utf8
from opslens.session import stored

WINDOW = 35
#: Words of the passages of one automaton, and stretches that one task streams through it at most.
SHARD_WORDS, SHARD_STRETCHES = 250_000, 25_000


def kind_of(window: int = WINDOW) -> Kind:
    size = max(1, window // 6)
    return Kind(word_symbols, window, max(1, window // 4), (3 * size, size))


# -- passages and stretches ------------------------------------------------------------------------------------------


def passages_and_stretches(rows: DataFrame, kind: Kind, found: Found, tokens: DataFrame) -> DataFrame:
    """``key, stretch, name, at, words``: passages (``stretch`` 0; those of ``tokens``) and all stretches of documents
    that may hold one (1)."""
    sent = rows.sparkSession.sparkContext.broadcast((found.known.arrays(), filter_of(tokens, "t"), filter_of(found.single, "h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, first_ones, recurring = sent.value
        known = Known.of(arrays)
        for batch in batches:
            names, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for first, last in packs(texts):
                own = names[first:last]
                data, starts, ends, bounds = words_of(texts[first:last])
                symbols, _ = word_symbols(texts[first:last])
                out: list[tuple] = []

                def add(keys, flag, text, low, high):
                    begin, finish = bounds[text] + low, bounds[text] + high + kind.length
                    for key, t, a, x, y in zip(keys.view(np.int64).tolist(), text.tolist(), low.tolist(), starts[begin].tolist(), ends[finish - 1].tolist()):
                        out.append((key, flag, int(own[t]), a, b" ".join(data[x:y].split())))

                for owned, sure, ask in decide(kind, symbols, bounds, own, known):
                    begin = bounds[owned.text] + owned.low - owned.origin
                    used = np.zeros(len(begin), bool)
                    for found, some in [*((x, np.ones(len(x.low), bool)) for x in sure), (ask, may_hold(recurring, ask.outer))]:
                        owner = np.searchsorted(begin, bounds[found.text] + found.low, "right") - 1
                        used[owner[some]] = True
                        rep = some & may_hold(first_ones, found.tokens(own))
                        add(owned.name[owner[rep]], 0, found.text[rep], found.low[rep], found.high[rep])
                    some = owned.take(used)
                    add(some.name, 1, some.text, some.low - some.origin, some.high - some.origin)
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "stretch", "name", "at", "words"])

    return small_batches(rows).mapInArrow(run, "key long, stretch long, name long, at long, words binary")


# -- automata --------------------------------------------------------------------------------------------------------


class Shard:
    """An automaton over the passages of one shard, and what it has found. Equal stretches are streamed once."""

    def __init__(self):
        self.number: dict[bytes, int] = {}  # of a word
        self.passages: list[bytes] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.ready = False
        self.seen: dict[bytes, list[tuple[int, int, int]]] = {}  # what a stretch holds
        self.counts: Counter = Counter()
        self.hits: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # name, place, (passage, start, end) found

    def add(self, words: bytes) -> None:
        numbers = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words.split())
        if numbers not in self.automaton:
            self.automaton.add_word(numbers, (len(self.passages), len(numbers)))
            self.passages.append(words)

    def stream(self, name: int, at: int, words: bytes) -> None:
        if not self.passages:
            return
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        found = self.seen.get(words)
        if found is None:
            number = self.number
            found = [(p, end + 1 - n, end + 1) for end, (p, n) in self.automaton.iter(tuple([number.get(w, 0) for w in words.split()]))]
            found.sort(key=lambda x: x[1])
            self.seen[words] = found
        if found:
            self.counts.update([p for p, _, _ in found])
            self.hits.append((name, at, found))

    def digest(self, passage: int) -> bytes:
        return hashlib.sha256(self.passages[passage]).digest()

    def spans(self, alone: bool) -> Iterator[tuple[int | None, int | None, int | None, bytes | None]]:
        """``name, start, end, passage``: places of confirmed passages, joined within a stretch (passage: none). If other
        tasks stream through the same shard, also those of passages found once here, and the passages that are confirmed."""
        if not alone:
            yield from ((None, None, None, self.digest(p)) for p, n in self.counts.items() if n > 1)
        for name, at, found in self.hits:
            low = high = -1
            for p, start, end in found:
                if self.counts[p] < 2:
                    if not alone:
                        yield name, at + start, at + end, self.digest(p)
                elif start > high:
                    if high > 0:
                        yield name, at + low, at + high, None
                    low, high = start, end
                else:
                    high = max(high, end)
            if high > 0:
                yield name, at + low, at + high, None


def occurrences(rows: DataFrame, owners: DataFrame, passages: int, passage_words: int, shard_words: int = SHARD_WORDS, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """``name, start, end``: where recurring passages are, in words.

    Shards are sized by the number of passages and of stretches. An owner with more than ``shard_stretches`` stretches
    has a shard of its own, whose stretches are dealt to several tasks, each with all passages of that owner.
    """
    total = owners.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-passages * passage_words // shard_words), -(-total // shard_stretches))
    hot = stored(owners.where(F.col("n") > shard_stretches).select(F.col("h").alias("key"), F.ceil(F.col("n") / F.lit(shard_stretches)).alias("tasks")))
    sized = rows.join(hot, "key", "left")
    alone = F.col("tasks").isNull()
    shard = F.when(alone, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key"))
    own = F.when(alone, F.array(F.lit(-1).cast("long"))).when(F.col("stretch") == 1, F.array(F.pmod(F.xxhash64("name", "at"), "tasks"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))
    dealt = sized.select(shard.alias("shard"), F.explode(own).alias("task"), alone.alias("alone"), "stretch", "name", "at", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, alone = None, Shard(), True

        def close() -> pa.RecordBatch:
            columns = list(zip(*shard.spans(alone))) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["name", "start", "end", "passage"])

        for batch in batches:
            for number, task, one, stretch, name, at, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (number, task) != now:
                    if now is not None:
                        yield close()
                    now, shard, alone = (number, task), Shard(), one
                if stretch:
                    shard.stream(name, at, words)
                else:
                    shard.add(words)
        if now is not None:
            yield close()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small_batches(dealt).repartition(parts, "shard", "task").sortWithinPartitions("shard", "task", "stretch")
    spans = stored(ordered.mapInArrow(run, "name long, start long, end long, passage binary"))
    sure = spans.where("passage is null").select("name", "start", "end")
    open_ = spans.where("passage is not null")
    found_by_all = F.sum(F.when(F.col("name").isNull(), 2).otherwise(1))
    again = open_.groupBy("passage").agg(found_by_all.alias("n")).where("n > 1").select("passage")
    return sure.unionByName(open_.where("name is not null").join(again, "passage", "left_semi").select("name", "start", "end"))


# -- operator --------------------------------------------------------------------------------------------------------


def remove_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = True, shard_words: int = SHARD_WORDS, shard_stretches: int = SHARD_STRETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row and, if asked for, the ``kept`` words joined by spaces.

    A word goes if a window of ``window`` words that covers it also starts elsewhere, in this document or another;
    windows are judged on the input. Null texts have no words, repeated rows are copies of each other, further columns
    are ignored, ids may be null, an empty table gives an empty result.
    """
    kind = kind_of(window)
    rows = named(docs, id_col, text_col)
    found = search(rows.select("name", "text"), kind)
    tokens = found.single.groupBy("h").agg(F.min("t").alias("t")).select("t")
    for one in found.passes:
        tokens = tokens.unionByName(one.where("n > 1").select("t"))
    tokens = stored(tokens)
    both = passages_and_stretches(rows.select("name", "text"), kind, found, tokens)
    places = occurrences(both, found.owners, tokens.count(), window + kind.sizes[0] - 1, shard_words, shard_stretches)
    places = stored(places.groupBy("name").agg(F.collect_set(F.struct("start", "end")).alias("at")))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(places, "name"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 if with_text else 3]
    columns = [x.split()[0] for x in schema.split(", ")]

    def finish(text: bytes, at: list | None) -> tuple:
        words = text.split()
        gone = np.zeros(len(words), bool)
        if at:
            span = np.array([(x["start"], x["end"]) for x in at], np.int64)
            gone = covered(len(words), span[:, 0], span[:, 1], 0)
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if at else words)
        row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        return (*row, kept) if with_text else row

    def arrays(found: list) -> list[pa.Array]:
        return [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that no passage can be in, finished where they are read."""
        for batch in batches:
            some = batch.filter(pa.array(~may_hold(sent.value, batch.column("name").to_numpy().view(np.uint64))))
            yield pa.record_batch([some.column("doc_id"), *arrays([finish(x, None) for x in utf8(some.column("text"))])], columns)

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(sent.value, batch.column("name").to_numpy().view(np.uint64))))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [finish(x, y) for x, y in zip(utf8(batch.column("text")), batch.column("at").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), *arrays(done)], columns)

    rows = small_batches(rows)
    answered = rows.mapInArrow(waiting, rows.schema).join(places, "name", "left").select("text", "doc_id", "at")
    return rows.mapInArrow(here, schema).unionByName(answered.mapInArrow(there, schema))
