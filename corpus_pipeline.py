"""Documents to training sequences: language identification, near-dedup, removal of repeats, redaction, packing.

Each stage takes and returns documents (the last one returns the pieces of packed sequences). A stage reads its input
several times, so ``run`` stores what a stage returns before the next one starts; a lost executor costs no stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm import language, packing, pii, simhash, suffix
from opslens.llm.support import read
from opslens.session import stored

#: Least share of a document's letters in its language.
LEAST_SCORE = 0.5
#: Bytes of a repeat that is removed. 51 words of common length have more (248 and up in 95 of 100 documents), so repeated
#: passages of over 50 words are found, unless their words are very short.
REPEAT_BYTES = 200
#: Pieces that a packing worker remembers in each of two generations; few, as the workers and the executors' heaps have
#: grown over the stages before and share their memory.
CACHED_PIECES = 40_000


def _held(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage works on, and all others in one struct, so that no name of theirs meets one of the stage's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    others = F.struct(F.lit(0).alias("none"), *([F.struct(*rest).alias("rest")] if rest else []))
    return docs.select(*used, others.alias("others"))


def _released(held: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from a frame made by ``_held``, some of them changed; ``n_chars`` follows a changed text."""
    if "text" in changed and "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    own = [c for c in held.columns if c != "others"]
    return held.select(*(changed.get(c, F.col(c) if c in own else F.col(f"others.rest.`{c}`")).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language that most of their letters are in; a missing ``lang`` is filled in.

    Rejected: texts that are null or have no letter, and mixed texts without a language of half of the letters. If no
    document has a language to learn from, all are rejected. An empty table stays empty.
    """
    held = _held(docs, "doc_id", "text", "lang")
    model = language.learn(held.where(~language.held_out()))
    known = language.predict(held, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _released(known.select("doc_id", "text", "others", F.coalesce("lang", "lang_pred").alias("lang")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of the smallest id, and of equal ids the one whose text has the
    smallest hash. A document without an id stays only where no other has one. Null and empty texts are equal to each other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # ids may be shared by different texts, so a row is known by its id and its text
    keyed = _held(docs, "doc_id", "text").withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), text))
    groups = simhash.near_duplicates(keyed.select("key", "text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), "key")
    ranked = keyed.select("key", order.alias("order")).distinct().join(groups, "key")
    first = stored(ranked.groupBy("component_id").agg(F.min("order").alias("first")).select("first.key"))
    one = Window.partitionBy("key").orderBy("key")
    kept = keyed.join(first, "key", "left_semi").withColumn("place", F.row_number().over(one)).where("place = 1")
    return _released(kept.select("doc_id", "text", "others"), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``REPEAT_BYTES`` bytes that occur twice; an emptied document stays, a null text
    stays null. An empty table stays empty."""
    held = _held(docs, "text")
    whole = held.select(F.struct(F.col("others"), F.col("text").isNull().alias("no_text")).alias("row"), "text")
    cut = suffix.remove_repeats(whole, length=REPEAT_BYTES, id_col="row")
    back = cut.select("doc_id.others", F.when(~F.col("doc_id.no_text"), F.col("kept")).alias("text"))
    return _released(back, docs, text=F.col("text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; null, empty and clean texts stay as they are."""
    return _released(pii.redact(_held(docs, "text")), docs, text=F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids. A null or empty text is its end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_pieces=CACHED_PIECES)


STAGES = [
    ("language", identify_language),
    ("simhash", drop_near_duplicates),
    ("suffix", drop_repeats),
    ("pii", redact),
    ("packing", pack),
]

#: Fingerprints, checks against vocabulary files and redaction are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
