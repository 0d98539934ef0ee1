"""Removal of byte strings that start more than once in a corpus.

The suffixes that matter are compared to a depth of ``length`` bytes only. See ``repeats`` for how they are sampled,
named, refined and merged; the README says why not every third byte is sampled and sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from opslens.llm.repeats import Kind, Known, byte_symbols, covered, packs, search, sure_windows
from opslens.llm.support import filter_of, may_hold, small_batches, utf8
from opslens.operators.joins import join_lookup
from opslens.session import stored

LENGTH = 400


def kind_of(length: int = LENGTH) -> Kind:
    return Kind(byte_symbols, length, max(1, length * 2 // 5), (32, 4) if length >= 64 else (4,))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``name, text, doc_id``: rows with the same name have the same text and id."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("name"), text.alias("text"), F.col(id_col).alias("doc_id"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row and, if asked for, ``spans`` and ``kept``.

    ``spans`` are the maximal removed runs as start and end (bytes), ``kept`` the remaining text (without what is left of
    a character that a cut has split; the hash is over all remaining bytes). A byte goes if some
    ``length``-byte string that covers it also starts elsewhere, in this document or another; strings are judged on
    the input. Null texts count as empty, repeated rows as copies of each other, further columns are ignored, ids may
    be null. An empty table gives an empty result.

    Most rows are finished where they are read; only those that may have single windows to look up are shuffled.
    """
    kind = kind_of(length)
    rows = named(docs, id_col, text_col)
    found = search(rows.select("name", "text"), kind)
    places = stored(found.single.groupBy("name").agg(F.array_distinct(F.collect_list("at")).alias("at")))
    sent = docs.sparkSession.sparkContext.broadcast((found.known.arrays(), filter_of(places, "name")))
    spans = "array<struct<start:long,end:long>>"
    figures = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", spans {spans}, kept string" * with_text
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL(figures).fields])
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()][: 3 if with_text else 1]
    columns = schema.fieldNames()

    def finish(texts: list[bytes], names: np.ndarray, more: list[np.ndarray] | None, known: Known) -> list[tuple]:
        out: list[tuple] = []
        for first, last in packs(texts):
            data, bounds = byte_symbols(texts[first:last])
            low, high = sure_windows(kind, data, bounds, names[first:last], known)
            single = np.concatenate([x + b for x, b in zip(more[first:last], bounds)]) if more else low[:0]
            gone = covered(len(data), np.concatenate([low, single]), np.concatenate([high, single]), length)
            for i, text in enumerate(texts[first:last]):
                own = gone[bounds[i] : bounds[i + 1]]
                step = np.diff(own.view(np.int8), prepend=0, append=0)
                starts, ends = np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if starts else text
                row = (len(text), int(own.sum()), len(starts), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"start": s, "end": e} for s, e in zip(starts, ends)], kept.decode("utf-8", "ignore")) if with_text else row)
        return out

    def arrays(found: list) -> list[pa.Array]:
        return [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that no single window can be in, finished where they are read."""
        known, waiting = Known.of(sent.value[0]), sent.value[1]
        for batch in batches:
            ready = ~may_hold(waiting, batch.column("name").to_numpy().view(np.uint64))
            some = batch.filter(pa.array(ready))
            rows = finish(utf8(some.column("text")), some.column("name").to_numpy(), None, known)
            yield pa.record_batch([some.column("doc_id"), *arrays(rows)], columns)

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later = may_hold(sent.value[1], batch.column("name").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(later))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known.of(sent.value[0])
        for batch in batches:
            more = [np.array(x or [], np.int64) for x in batch.column("at").to_pylist()]
            rows = finish(utf8(batch.column("text")), batch.column("name").to_numpy(), more, known)
            yield pa.record_batch([batch.column("doc_id"), *arrays(rows)], columns)

    rows = small_batches(rows)
    asked = rows.mapInArrow(waiting, rows.schema)
    answered = join_lookup(asked, places, "name", "left").select("name", "text", "doc_id", "at")
    return rows.mapInArrow(here, schema).unionByName(answered.mapInArrow(there, schema))
