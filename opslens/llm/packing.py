"""Hierarchical packing of token sequences into windows of several lengths.

Documents are tokenised and packed where they are read: no shuffle, and a task holds one block of tokens at a time.
Within a block, text beyond the longest window is cut into full windows; the rest is routed to the shortest tier that
holds it. Tiers are packed from the longest: a window starts with the longest document of its tier, its gap takes the
longest pieces of shorter tiers that fit, and a last gap takes the head of a piece, whose tail is routed anew. So all
windows are full; what remains goes on to the next block, and at the end of a partition into ever shorter windows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import Recent, kept_in_worker, small_batches, utf8

TIERS = (4096, 2048, 1024, 512)
#: Shortest window that the end of a partition is cut into; a shorter rest is padded to the longest window.
LEAST_WINDOW = 64
#: Tokens that are packed together, and tokens of a step group.
BLOCK_TOKENS, STEP_TOKENS = 64 * 4096, 16 * 4096
END_ID = 2
#: Pieces whose ids a worker remembers in each of two generations; about 150 bytes each.
CACHED_PIECES = 200_000

Piece = tuple[int, int, int]  # length, document, start


# -- plan ------------------------------------------------------------------------------------------------------------


def pack(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of the tier sizes, each a list of pieces in order, and the pieces that do not fill one (together
    shorter than the longest window). Empty documents are left out."""
    top = tiers[0]
    windows: list[list[Piece]] = []
    pool: list[Piece] = []
    for doc, length in enumerate(lengths):
        whole = length // top * top
        windows += [[(top, doc, start)] for start in range(0, whole, top)]
        if length > whole:
            pool.append((length - whole, doc, whole))
    pool.sort()
    for tier, lower in zip(tiers, [*tiers[1:], 0]):
        while pool and pool[-1][0] > lower:
            window = [pool.pop()]
            gap = tier - window[0][0]
            while gap and pool:
                fits = bisect_right(pool, (gap, len(lengths), 0))
                if fits:
                    window.append(pool.pop(fits - 1))
                else:
                    length, doc, start = pool.pop(0)
                    window.append((gap, doc, start))
                    insort(pool, (length - gap, doc, start + gap))
                gap -= window[-1][0]
            if gap:
                return windows, window
            windows.append(window)
    return windows, []


def last_windows(pieces: Sequence[Piece], longest: int, least: int = LEAST_WINDOW) -> list[list[Piece]]:
    """The last pieces of a partition in windows of falling powers of two, and a shorter one at the end."""
    rest, out = list(pieces), []
    total, size = sum(p[0] for p in rest), longest
    while total:
        while size > max(total, least):
            size //= 2
        window, gap = [], min(size, total)
        total -= gap
        while gap:
            length, doc, start = rest.pop(0)
            now = min(length, gap)
            window.append((now, doc, start))
            if now < length:
                rest.insert(0, (length - now, doc, start + now))
            gap -= now
        out.append(window)
    return out


def step_groups(windows: Sequence[Sequence[Piece]], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for every window, so that groups have about the same number of tokens: long windows first, each to the
    group that has least."""
    sizes = [sum(p[0] for p in w) for w in windows]
    filled = [0] * max(1, round(sum(sizes) / tokens))
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        groups[i] = filled.index(min(filled))
        filled[groups[i]] += sizes[i]
    return groups


# -- tokens ----------------------------------------------------------------------------------------------------------


class PieceTokenizer:
    """Ids of texts from a tokenizer that lowers a text, splits it into pieces by a pattern and encodes each piece alone.

    Each piece is encoded once, by the library's model, and remembered. Texts of plain characters (those that Unicode
    normalisation leaves alone and that every lower-casing treats alike) are lowered and split here; a text with any
    other character, or with what may be a special token, goes to the library as a whole.
    """

    LATIN = "\xdf-\xf6\xf8-\xff\u0100-\u012f\u0131-\u0148\u014a-\u017e"  # letters beyond ASCII, after lowering
    PLAIN = f"\t\n\x0b\x0c\r\x20-\x7e\xc0-\xd6\xd8-\xde{LATIN}\u2010-\u2027\u20ac"
    #: Fixed value: the vocabulary's own pattern, over plain characters.
    PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\\s0-9a-z{LATIN}]+"

    #: Plain bytes, which need no look at their characters.
    PLAIN_BYTES = bytes([*range(9, 14), *range(32, 127)])

    def __init__(self, path: str, cached_pieces: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces_in = re.compile(self.PIECES).findall
        self.odd = re.compile(f"[^{self.PLAIN}]").search
        self.known: dict[str, bytes] = Recent(cached_pieces)
        # a byte-level vocabulary writes printable bytes as themselves and the others as characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.written = {b: 256 + i for i, b in enumerate(rest)}

    def is_plain(self, text: bytes, decoded: str) -> bool:
        rest = text.translate(None, self.PLAIN_BYTES)  # an ASCII byte is no part of another character
        return b"<|" not in text and "\ufffd" not in decoded and not (rest and self.odd(rest.decode("utf-8", "replace")))

    def encode_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.written)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        decoded = [x.decode("utf-8", "replace") for x in texts]
        split = [self.pieces_in(t.lower()) if self.is_plain(x, t) else None for x, t in zip(texts, decoded)]
        own = [s for s in split if s]
        known = self.known
        fresh = known.admit(set(chain.from_iterable(own)))
        known.update((p, self.encode_piece(p)) for p in fresh)
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
        return [whole(t) if s is None else np.frombuffer(b"".join(map(known.__getitem__, s)), "<u4") for t, s in zip(decoded, split)]


# -- operator --------------------------------------------------------------------------------------------------------


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: Sequence[int] = TIERS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
    cached_pieces: int = CACHED_PIECES,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group``
    and, if asked for, its ``ids``.

    Every document is its tokens and ``end_id``; a null or empty text is ``end_id`` alone. Each id lies in one piece,
    the pieces of a sequence follow each other without a gap, and ``window`` is the length a sequence is padded to: its
    own if that is a power of two, else the longest tier. Only the last sequence of a partition can need padding.
    Repeated rows are packed as often as they are given, ids may be null, further columns are ignored, and an empty
    table gives an empty result. ``sequence_id`` is unique across partitions. ``cached_pieces`` bounds what a worker remembers,
    and changes the time alone.
    """
    tiers = tuple(sorted(tiers, reverse=True))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", *["ids"] * with_ids]

    def rows(windows: list[list[Piece]], held: list[tuple], base: int, group: int, like: pa.DataType) -> pa.RecordBatch:
        out: list[tuple] = []
        groups = step_groups(windows)
        for number, (window, own) in enumerate(zip(windows, groups)):
            offset, size = 0, sum(p[0] for p in window)
            padded = size if size & (size - 1) == 0 else tiers[0]
            for length, doc, start in window:
                doc_id, skipped, ids, total = held[doc]
                part = ids[start : start + length]
                out.append((doc_id, skipped + start, length, zlib.crc32(part), total, base + number, offset, padded, group + own, part))
                offset += length
        columns = [pa.array([r[i] for r in out], like if not i else pa.int64()) for i in range(9)]
        if with_ids:
            columns.append(pa.array([r[9].astype(np.int32) for r in out], pa.list_(pa.int32())))
        return pa.record_batch(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(f"tokens {cached_pieces} {tokenizer}", lambda: PieceTokenizer(tokenizer, cached_pieces))
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId() << 36
        made = groups = 0
        held: list[tuple] = []  # id, tokens before these, the tokens, all tokens of the document
        like = None

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, groups, held
            windows, rest = pack([len(x[2]) for x in held], tiers)
            if last:
                windows, rest = windows + last_windows(rest, tiers[0]), []
            if windows:
                yield rows(windows, held, part + made, part + groups, like)
                made += len(windows)
                groups += max(step_groups(windows)) + 1
            held = [(held[d][0], held[d][1] + s, held[d][2][s : s + n], held[d][3]) for n, d, s in rest]

        for batch in batches:
            like = batch.column(0).type
            texts = utf8(batch.column(1))
            for first in range(0, len(texts), 256):
                for doc_id, ids in zip(batch.column(0).slice(first, 256).to_pylist(), encode(texts[first : first + 256])):
                    ids = np.concatenate([ids, end])
                    held.append((doc_id, 0, ids, len(ids)))
                if sum(len(x[2]) for x in held) >= BLOCK_TOKENS:
                    yield from block(False)
        if held:
            yield from block(True)
        encode.known.rest()

    schema = f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:9]) + ", ids array<int>" * with_ids
    return small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
