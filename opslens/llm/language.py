"""Language of texts: scripts narrow the candidates, words are scored, and a Viterbi path labels spans of mixed text.

A word's score for a language is the sum of the log-probabilities of its character triples (with its edges) in that
language. A language takes part in the words of a script if enough of its own letters are of that script. The best path
over a text's words pays a penalty for every change of language; the text has the language of most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.llm.support import per_batch, small_batches, utf8

#: Labelled documents of each language from which is learned, about: all up to so many, of more that share by their hash.
TRAINING_DOCS = 20_000
#: Hash buckets of character triples.
BUCKETS = 1 << 16
#: Cost of a change of language between two words, as a log-probability.
PENALTY = 12.0
#: Share of its letters in a script from which on a language is a candidate for words of the script.
LEAST_SCRIPT = 0.01
UNKNOWN = "und"
_PACK = 1 << 19
_SLOTS = 1 << 24

#: Ranges of code points and the script they belong to; what is in none counts as one more script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
_NAMES = sorted({s[0] for s in SCRIPTS})
OTHER = len(_NAMES)


def letter_scripts() -> np.ndarray:
    """For every code point its script's number plus one if it is a letter, else 0."""
    script = np.full(0x110000, OTHER + 1, np.uint8)
    for name, low, high in SCRIPTS:
        script[low : high + 1] = _NAMES.index(name) + 1
    script[[i for i in range(0x110000) if not chr(i).isalpha()]] = 0
    return script


class Letters:
    """The words of several texts as letters: buckets of triples, scripts, and where words and texts begin."""

    def __init__(self, texts: list[str], table: np.ndarray):
        texts = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        lengths = [len(t) + 1 for t in texts]
        script = table[np.minimum(code, 0x10FFFF)]
        letter = script > 0
        places = np.flatnonzero(letter)
        code = np.where(letter, code, 0).astype(np.uint64)
        mix = code[places - 1] * np.uint64(0x9E3779B97F4A7C15) + code[places] * np.uint64(0xC2B2AE3D27D4EB4F) + code[places + 1] * np.uint64(0x165667B19E3779F9)
        self.buckets = ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS
        self.scripts = script[places].astype(np.int64) - 1
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1] + 1
        self.words = np.flatnonzero(new)  # first letter of each word
        ends = np.cumsum([1, *lengths])
        self.texts = np.searchsorted(places[self.words], ends)  # first word of each text; the end comes last
        self.sizes = np.diff(np.append(self.words, len(places)))


class Model:
    """Log-probabilities of triples for each language (``buckets`` by language) and candidates by script."""

    def __init__(self, languages: list[str], scores: np.ndarray, candidates: np.ndarray, table: np.ndarray, penalty: float = PENALTY):
        self.languages, self.scores, self.candidates, self.table, self.penalty = languages, scores, candidates, table, penalty

    def arrays(self) -> tuple:
        return self.languages, self.scores, self.candidates, self.table, self.penalty

    def word_scores(self, letters: Letters) -> np.ndarray:
        if not len(letters.words):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.zeros((len(letters.words), len(self.languages)), np.float32)
        ends = np.append(letters.words, len(letters.buckets))
        at = 0
        while at < len(out):  # by pieces of whole words
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _PACK, "right")) - 1)
            rows = self.scores[letters.buckets[ends[at] : ends[upto]]]
            out[at:upto] = np.add.reduceat(rows, letters.words[at:upto] - ends[at], axis=0)
            at = upto
        allowed = self.candidates[letters.scripts[letters.words]]
        return np.where(allowed, out, out.min(axis=1, keepdims=True) - np.float32(4 * self.penalty))

    def paths(self, letters: Letters) -> np.ndarray:
        """Language number of every word: the best path of each text, all texts step by step together."""
        scores, first = self.word_scores(letters), letters.texts[:-1]
        count = np.diff(letters.texts)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        n, k = len(scores), len(self.languages)
        back = np.zeros((n, k), np.int16)
        path = np.zeros(n, np.int64)
        if not n:
            return path
        own = np.arange(k, dtype=np.int16)
        active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), "right")  # texts that have a word number t
        best = scores[first[: active[0]]].astype(np.float64)
        last = np.zeros(active[0], np.int64)
        for t in range(1, len(active)):
            m = active[t]
            if m < len(best):
                last[m : len(best)] = best[m:].argmax(axis=1)
                best = best[:m]
            top = best.argmax(axis=1)
            switch = best[np.arange(m), top] - self.penalty
            stay = best >= switch[:, None]
            at = first[:m] + t
            back[at] = np.where(stay, own, top[:, None])
            best = np.where(stay, best, switch[:, None]) + scores[at]
        last[: len(best)] = best.argmax(axis=1)
        state = last
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            path[at] = state[:m]
            if t:
                state[:m] = back[at, state[:m]]
        return path

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Language, its share of the letters, and the spans as language, first word and end, of each text."""
        letters = Letters(texts, self.table)
        if not self.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        path = self.paths(letters)
        out = []
        for low, high in zip(letters.texts, letters.texts[1:]):
            if low == high:
                out.append((UNKNOWN, 0.0, []))
                continue
            own = path[low:high]
            share = np.bincount(own, letters.sizes[low:high], len(self.languages))
            turn = np.flatnonzero(np.diff(own, prepend=-1))
            spans = [(self.languages[own[a]], int(a), int(b)) for a, b in zip(turn, [*turn[1:], len(own)])]
            out.append((self.languages[int(share.argmax())], float(share.max() / share.sum()), spans))
        return out


def packs(texts: list[str]) -> Iterator[list[str]]:
    pack: list[str] = []
    size = 0
    for text in texts:
        if pack and size + len(text) > _PACK:
            yield pack
            pack, size = [], 0
        pack.append(text)
        size += len(text)
    if pack:
        yield pack


def learn(docs: DataFrame, training_docs: int = TRAINING_DOCS, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a sample of about ``training_docs`` rows of each language, so that none crowds out another. Without
    any, every text is of unknown language."""
    table = letter_scripts()
    sent = docs.sparkSession.sparkContext.broadcast(table)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, buckets, counts = [], [], []
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            by.setdefault(lang, []).append(text.decode("utf-8", "replace"))
        for lang, texts in by.items():
            for pack in packs(texts):
                letters = Letters(pack, sent.value)
                for values, offset in ((letters.buckets, 0), (letters.scripts, BUCKETS)):
                    found, n = np.unique(values, return_counts=True)
                    langs += [lang] * len(found)
                    buckets += (found + offset).tolist()
                    counts += n.tolist()
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(buckets, pa.int64()), pa.array(counts, pa.int64())], ["lang", "bucket", "n"])

    labelled = labelled.withColumn("h", F.xxhash64("id", "text"))
    counts = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("docs"))  # a row for each language
    sample = labelled.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(_SLOTS)) * F.col("docs") < F.lit(_SLOTS * training_docs)).select("lang", "text")
    rows = per_batch(sample, "lang string, bucket long, n long", run).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + OTHER + 1, len(languages)))
    counts[rows["bucket"].to_numpy(), [languages.index(x) for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    triples, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((triples + 0.5) / (triples.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    candidates = scripts / np.maximum(scripts.sum(axis=0), 1) >= LEAST_SCRIPT
    candidates[~candidates.any(axis=1)] = True  # a script that no language is written in rules none out
    return Model(languages, scores, candidates, table, penalty)


def predict(docs: DataFrame, model: Model, with_spans: bool = False, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but one named like a result), ``lang_pred``, ``score`` and, if asked for, ``spans``.

    ``und`` and score 0 if the text is null or has no letter. The score is the share of the text's letters in spans of
    the language. Repeated rows and null ids are returned as given; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())
    kept = docs.drop("lang_pred", "score", "spans", "_held").withColumn("_held", F.col(text_col))
    span = "array<struct<lang:string,start:long,end:long>>"
    extra = ", ".join(["lang_pred string", "score double"] + [f"spans {span}"] * with_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            found = []
            for pack in packs([x.decode("utf-8", "replace") for x in utf8(batch.column(batch.num_columns - 1))]):
                found += model.label(pack)
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if with_spans:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                columns.append(pa.array([[dict(zip(("lang", "start", "end"), s)) for s in f[2]] for f in found], kind))
            yield pa.record_batch([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang_pred", "score", *["spans"] * with_spans])

    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(extra).fields])
    return small_batches(kept).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: those whose id as text has a CRC-32 of remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


