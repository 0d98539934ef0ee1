"""Top-k search and the pipeline against brute force; what is registered."""

import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fixtures import DOCS_DDL, corpus, ordered, prose, simhash_rows, suffix_rows
from opslens.llm import packing, pii, queries, topk
from opslens.session import stored
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# -- top-k -----------------------------------------------------------------------------------------------------------


def best(rows, k):
    vectors = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in vectors:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return out


VECTORS = "vec_id long, embedding array<double>, d string, v int"


@pytest.mark.parametrize("k, blocks", [(5, (8192, 1024)), (3, (40, 2)), (400, (100, 100))])
def test_top_k_with_ties_copies_and_unusable_vectors(spark, k, blocks):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.123, 2.0]) for _ in range(6)]) for i in range(310)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [rows[7], rows[100], (500, [0.0] * 6), (501, [1e-9] * 6)]
    rows += [(600, None), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, [1.0] * 6), (650, []), (651, [1.0] * 3), (700, [2.0] * 3)]
    df = topk.quantised(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)).repartition(5)
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, k, pivots=4, candidate_block=blocks[0], query_block=blocks[1])
    assert ordered(got.collect()) == ordered(best(rows, k))


def test_top_k_of_nothing(spark):
    none = topk.quantised(spark.createDataFrame([], VECTORS))
    one = topk.quantised(spark.createDataFrame([(50, [1.0], "x", 1)], VECTORS))
    for queries_, candidates in ((none, one), (one, none), (one, one)):
        assert topk.top_k(queries_, candidates).collect() == []


# -- pipeline --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns over the fixture."""
    docs = spark.createDataFrame(corpus(), DOCS_DDL).select(*COLUMNS).repartition(3)
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], FOLDER)))
    return found


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "simhash", "suffix", "pii", "packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_language_stage_drops_what_has_no_language(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    letters = [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
    assert set(after) <= {(*r[:2], r[2] or x, *r[3:]) for r in letters for x in ("en", "xx")}
    assert all(r[2] is not None for r in after) and len(after) >= 0.8 * len(letters)


def test_one_document_of_each_group_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    groups = {c for _, _, c in simhash_rows(before, 4, 4)}
    assert sorted(r[0] for r in after) == sorted(groups) and set(after) <= set(before)


def test_each_group_keeps_a_document_where_ids_are_shared(spark):
    rng = random.Random(5)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (2, c), (1, a), (None, c), (3, c + " x"), (None, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text or "") for r in pipeline.drop_near_duplicates(spark, df, FOLDER).collect()]
    assert ordered(got) == ordered([(1, a), (1, b), (2, c), (None, "")])


def test_repeats_are_cut(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    want = {r[0]: n for r, (_, _, n, _, _) in zip(before, suffix_rows(before, pipeline.REPEAT_BYTES))}
    assert sorted(r[0] for r in after) == sorted(want)
    for r in after:
        text = next(b[1] for b in before if b[0] == r[0])
        assert len(text.encode()) - len(r[1].encode()) - want[r[0]] in range(0, 8) and r[4] == len(r[1])


def test_redaction_and_packing(spark, stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert ordered(after) == ordered(before)  # the fixture's prose has no personal data
    encode = packing.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    pieces = stages[5].collect()
    assert sum(r.length for r in pieces) == sum(len(encode.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in after)


def test_stages_take_empty_tables_and_rows_without_ids(spark, stages):
    none = spark.createDataFrame([], DOCS_DDL).select(*COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, FOLDER).collect() == []
    rows = [(None, "some words here", "en", None, None)] * 2 + [(None, None, None, None, None), (5, "some words here", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, df, FOLDER).collect()} == {None, 5}
    assert pipeline.drop_near_duplicates(spark, df.where("doc_id is null"), FOLDER).count() == 2
    assert [r.text for r in pipeline.drop_repeats(spark, df, FOLDER).collect()].count(None) == 1
    assert pipeline.redact(spark, df, FOLDER).count() == 4


def test_stages_keep_columns_with_any_name(spark):
    """Names that the operators use themselves, and one with a dot."""
    names = ["score", "spans", "lang_pred", "_held", "_key", "_row", "_spans", "key", "row", "others", "place", "text_", "a.b", "component_id", "_"]
    base = [r[:5] for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame([(*r, *(f"{n} {r[0]}" for n in names)) for r in base], ["doc_id", "text", "lang", "source", "n_chars", *names])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for name, stage in pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, FOLDER))
        assert after.columns == docs.columns, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in after.collect() for n in names), name
        docs = after
    assert docs.count() and pipeline.pack(spark, docs, FOLDER).count()


def test_personal_data_leaves_the_pipeline(spark):
    rows = [(1, "Reach me: a@b.cd, card 4111 1111 1111 1111.", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = pipeline.redact(spark, df, FOLDER).collect()
    assert r.text == "Reach me: <EMAIL>, card <CARD>." and r.n_chars == len(r.text) and pii.digest(spark.createDataFrame([r])).first().spans == ""


# -- registered queries ----------------------------------------------------------------------------------------------


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE_SQL[name]) == ""


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert all_ > 200 and right / all_ > 0.97


def test_packing_workers_of_the_pipeline_remember_few_pieces(monkeypatch):
    # four workers share an executor's memory with a heap that the stages before have filled
    monkeypatch.setattr(packing, "pack_documents", lambda docs, tokenizer, cached_pieces=packing.CACHED_PIECES: cached_pieces)
    assert pipeline.pack(None, None, "") <= 50_000
