"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text is its characters, spaces being U+2581 and one of them put in front. All adjacent pairs whose join is in the
vocabulary are on the agenda; the pair of the highest score (the leftmost of a tie) is merged and its new neighbours
join the agenda. What is not in the vocabulary at the end becomes bytes.

No piece of the vocabulary goes from another character on to a space mark, joins a sign or digit and a letter (any other character), or
holds a line feed beside anything (checked when the vocabulary is loaded). So no merge crosses these places: texts are
encoded by the parts between them, and each part once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import Recent, kept_in_worker, small_batches, utf8

MARK = "▁"
#: Parts whose ids a worker remembers in each of two generations; about 200 bytes each.
CACHED_PARTS = 400_000
#: Characters of a part up to which it is encoded together with all new parts of its length.
SHORT_PART = 24
_SIGNS = r"\x00-\t\x0b-@\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u2580\u2582-\u2bff"  # no letters, line feed or space mark
_OTHER, _LETTER = f"[{_SIGNS}]", f"[^{_SIGNS}\n{MARK}]"
_PARTS = re.compile(f"{MARK}*{_LETTER}+|{MARK}*{_OTHER}+|{MARK}+|\n")
_CROSSING = re.compile(f"[^{MARK}]{MARK}|{_LETTER}{_OTHER}|{_OTHER}{_LETTER}|.\n|\n.", re.S)


class MergeEncoder:
    """Encoder for one vocabulary file; every new part is checked against the library in the batch that brings it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(sp.get_piece_size())
        special = {i for i in pieces if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.ids = {sp.id_to_piece(i): i for i in pieces if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(_CROSSING.search(p) for p in self.ids):
            raise ValueError("pieces of this vocabulary cross the parts of a text")
        self.pairs = self.pairs_of_symbols()
        self.known: dict[str, bytes] = Recent(CACHED_PARTS)

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part by the agenda."""
        scores, ids = self.scores, self.ids
        symbols: list = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            score = scores.get(joined := symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, joined))
        heapify(agenda)
        while agenda:
            _, i, joined = heappop(agenda)
            if (left := symbols[i]) is None or (j := after[i]) >= n or left + symbols[j] != joined:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                score = scores.get(more := joined + symbols[k])
                if score is not None:
                    heappush(agenda, (-score, i, more))
            if (h := before[i]) >= 0:
                score = scores.get(more := symbols[h] + joined)
                if score is not None:
                    heappush(agenda, (-score, h, more))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                found = ids.get(s)
                if found is None:
                    out.extend(self.bytes[b] for b in s.encode())
                else:
                    out.append(found)
        return out

    def symbol(self, text: str) -> int:
        """Number of a symbol: a piece's id, and beyond all ids the code point of any other character."""
        found = self.ids.get(text)
        return len(self.strings) + ord(text) if found is None else found

    def pairs_of_symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending keys of all pairs of symbols whose join is in the vocabulary, with the join's score and number; a last
        key stands for no pair."""
        self.strings = [str(i) for i in range(self.library.get_piece_size())]
        self.symbols = np.arange(0x110000, dtype=np.int64) + len(self.strings)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        is_symbol = lambda x: len(x) == 1 or x in self.ids
        found = sorted(
            (self.symbol(p[:k]) << 32 | self.symbol(p[k:]), self.scores[p], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if is_symbol(p[:k]) and is_symbol(p[k:])
        )
        keys, scores, joined = zip(*found, (2**63 - 1, -np.inf, 0))
        return np.array(keys, np.int64), np.array(scores), np.array(joined, np.int64)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of pairs of symbols, and the numbers of their joins."""
        keys, scores, joined = self.pairs
        wanted = left << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, scores[at], -np.inf), joined[at]

    def merged(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the symbols of parts of equal length (a row each), a pair of every part at a time; yields numbers of parts
        and their symbols when nothing merges them any more. A row's agenda is its pairs' scores: the first highest is next."""
        parts = np.arange(len(symbols))
        scores, joined = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1 and len(parts):
            best, row = scores.argmax(1), np.arange(len(parts))
            open_ = scores[row, best] > -np.inf
            if not open_.all():
                yield parts[~open_], symbols[~open_]
                parts, symbols, scores, joined, best = (x[open_] for x in (parts, symbols, scores, joined, best))
                row = row[: len(parts)]
            n, width = symbols.shape
            symbols[row, best] = joined[row, best]
            place = np.arange(width)
            symbols = symbols[place != best[:, None] + 1].reshape(n, width - 1)
            rest = place[:-1] != best[:, None]
            scores, joined = scores[rest].reshape(n, width - 2), joined[rest].reshape(n, width - 2)
            for rows, at in ((row[best > 0], best[best > 0] - 1), (row[best < width - 2], best[best < width - 2])):
                scores[rows, at], joined[rows, at] = self.looked_up(symbols[rows, at], symbols[rows, at + 1])
        yield parts, symbols

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts (32 bits each) by the agenda: short ones together with all of their length, others one by one."""
        out = [b""] * len(parts)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            if len(p) > SHORT_PART:
                out[i] = packed(self.encode_part(p))
            else:
                by_length.setdefault(len(p), []).append(i)
        for length, which in by_length.items():
            chars = np.frombuffer("".join([parts[i] for i in which]).encode("utf-32-le"), "<u4")
            for own, symbols in self.merged(self.symbols[chars].reshape(-1, length)):
                data, size = symbols.astype(np.int32).tobytes(), 4 * symbols.shape[1]
                for k, i in enumerate(own.tolist()):
                    out[which[i]] = data[k * size : (k + 1) * size]
                for k in np.flatnonzero((symbols >= len(self.strings)).any(1)).tolist():
                    ids = [[s] if s < len(self.strings) else self.bytes_of(s) for s in symbols[k].tolist()]
                    out[which[own[k]]] = packed(list(chain.from_iterable(ids)))
        return out

    def bytes_of(self, symbol: int) -> list[int]:
        return [self.bytes[b] for b in chr(symbol - len(self.strings)).encode()]

    def learn(self, parts: list[str]) -> None:
        found = self.encode_parts(parts)
        line = packed(self.encode_part("\n"))
        ours = packed(self.encode_part(MARK)) + line + line.join(found)
        if ours != packed(self.library.encode("\n" + "\n".join(parts).replace(MARK, " "))):
            raise ValueError("the agenda's ids differ from the library's")
        self.known.update(zip(parts, found))

    def __call__(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same as decimal text joined by commas."""
        split = [_PARTS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        found = [list(map(known.get, s)) for s in split]
        lacking = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        if fresh := known.admit({s[i] for s, places in zip(split, lacking) for i in places}):
            self.learn(list(fresh))
        out, text = [], self.strings.__getitem__
        for s, f, places in zip(split, found, lacking):
            for i in places:
                f[i] = known[s[i]]
            ids = memoryview(b"".join(f)).cast("i").tolist()
            out.append((ids, ",".join(map(text, ids))))
        return out


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def encode_documents(docs: DataFrame, model: str, outputs: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row and, if asked for, ``ids`` and the ``decoded`` text.

    Null texts count as empty; an empty text has no ids and decodes to an empty text. Repeated rows and null ids are
    returned as given, further columns are ignored, an empty table gives an empty result. Decoding is the library's.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(f"pieces {model}", lambda: MergeEncoder(model))
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in utf8(batch.column(1))]
            for first in range(0, len(texts), 256):
                found = encode(texts[first : first + 256])
                ids = [f[0] for f in found]
                decoded = [encode.library.decode(i) if i else "" for i in ids]
                columns = [batch.column(0).slice(first, 256), pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(f[1]) for f in found]), pa.array(map(sha, decoded))]
                if outputs:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.record_batch(columns, names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    return small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
