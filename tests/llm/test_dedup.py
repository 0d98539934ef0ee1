"""SimHash groups, repeated byte strings and recurring passages against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import DOCS_DDL, corpus, ordered, phrase_rows, prose, simhash_rows, suffix_rows
from opslens.llm import phrases, repeats, simhash, suffix
from opslens.llm.support import components, filter_of, may_hold, mixed


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS_DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS_DDL)


# -- SimHash ---------------------------------------------------------------------------------------------------------


def test_near_duplicates(docs):
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(simhash_rows(corpus(), 4, 4))


@pytest.mark.parametrize("shingle, bits, block", [(1, 4, 4), (2, 7, 8192), (4, 0, 3)])
def test_near_duplicates_with_other_parameters_and_small_blocks(docs, shingle, bits, block):
    got = simhash.near_duplicates(docs, shingle, bits, block)
    assert ordered(got.collect()) == ordered(simhash_rows(corpus(), shingle, bits))


def test_no_documents(none):
    assert simhash.near_duplicates(none).collect() == []
    assert suffix.remove_repeats(none).collect() == []
    assert phrases.remove_passages(none).collect() == []


def test_every_word_is_near_one_anchor_and_one_bit_is_covered():
    masks, lower, upper = simhash.anchor_masks(1)
    masks_of = lambda v: masks[lower[v & 0xFFF] ^ upper[v >> 12]]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 5000)
    anchors = lambda v: {a for a in (v ^ masks_of(v)).tolist()} - {v ^ -1}
    for v in x[:500].tolist():
        own = [m for m in masks_of(v) if m >= 0]
        assert sum(int(m).bit_count() <= 3 for m in own) == 1
        for bit in range(23):
            assert anchors(v) & anchors(v ^ 1 << bit)


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noisy = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(8)]
    fps = np.unique(np.array(noisy, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components(simhash.links(df, 4, block=16)).collect()}
    label = {int(x): int(x) for x in fps.view(np.int64)}
    for _ in range(len(fps)):
        for i, a in enumerate(fps):
            near = fps[np.bitwise_count(fps ^ a) <= 4].view(np.int64).tolist()
            least = min(label[b] for b in near)
            for b in near:
                label[b] = min(label[b], least)
    assert all(found.get(x, x) == y for x, y in label.items())


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- repeats ---------------------------------------------------------------------------------------------------------


def test_repeated_bytes(docs):
    got = suffix.remove_repeats(docs)
    assert ordered(got.drop("spans", "kept").collect()) == ordered(suffix_rows(corpus(), 400))
    for r in got.where("doc_id is not null").collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans)


@pytest.mark.parametrize("length", [5, 24, 100])
def test_repeated_bytes_of_other_lengths_and_cut_texts(docs, monkeypatch, length):
    monkeypatch.setattr(repeats, "SEGMENT", 4096)
    got = suffix.remove_repeats(docs, length, with_text=False)
    assert ordered(got.collect()) == ordered(suffix_rows(corpus(), length))


def test_full_filters_only_cost_work(docs, monkeypatch):
    monkeypatch.setattr(repeats, "filter_of", lambda df, column: filter_of(df, column, 64))
    monkeypatch.setattr(suffix, "filter_of", lambda df, column: filter_of(df, column, 64))
    assert ordered(suffix.remove_repeats(docs, 60, with_text=False).collect()) == ordered(suffix_rows(corpus(), 60))


def test_partitioning_does_not_matter(spark):
    rng = random.Random(9)
    base = [prose(rng, 200) for _ in range(20)]
    rows = []
    for i in range(120):
        a, b = rng.choice(base), rng.choice(base)
        k = rng.randint(0, len(a))
        rows.append((i, a[:k] + b[rng.randint(0, len(b)) :]))
    want = ordered(suffix_rows(rows, 90))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert ordered(suffix.remove_repeats(df, 90, with_text=False).collect()) == want
        assert ordered(phrases.remove_passages(df, 12, with_text=False, shard_words=400, shard_stretches=20).collect()) == ordered(phrase_rows(rows, 12))


def test_recurring_passages(docs):
    assert ordered(phrases.remove_passages(docs, with_text=False).collect()) == ordered(phrase_rows(corpus(), 35))


@pytest.mark.parametrize("window", [2, 7, 20])
def test_recurring_passages_in_small_shards(docs, window):
    got = phrases.remove_passages(docs, window, with_text=False, shard_words=300, shard_stretches=15)
    assert ordered(got.collect()) == ordered(phrase_rows(corpus(), window))


def test_kept_text_is_what_is_hashed(docs):
    for r in phrases.remove_passages(docs).collect():
        assert len(r.kept.split()) == r.n_words - r.n_removed


def test_filter_finds_all_and_little_else(spark):
    df = spark.range(20000).select(F.xxhash64("id").alias("h"))
    words = filter_of(df, "h")
    assert may_hold(words, np.array([r.h for r in df.collect()], np.int64).view(np.uint64)).all()
    assert may_hold(words, mixed(np.arange(10**5, dtype=np.uint64))).mean() < 0.05
