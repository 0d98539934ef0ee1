"""Packing and piece encoding against the libraries, with exact round trips."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import DOCS_DDL, corpus, crc, ordered
from opslens.llm import packing, pieces

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "don't I'm  x <|endoftext|>a", "ΑΣ ΣΑΣ İı ﬁ Ａ１２ ½²", "é ́", "日本語 한국어", "a\x1cb\x85c​d e", "▁▁a ▁\n\n x\n", "\t\U0001f600 zz  ", "<s> </s> <unk> <0x0A>"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS_DDL).repartition(3)


# -- plan ------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.sampled_from([(16, 8, 4), (8,), (32, 16, 8, 4, 2, 1)]))
def test_windows_are_full_and_hold_every_token_once(lengths, tiers):
    windows, rest = packing.pack(lengths, tiers)
    assert all(sum(p[0] for p in w) in tiers for w in windows)
    assert sum(p[0] for p in rest) < tiers[0]
    final = packing.last_windows(rest, tiers[0], 2)
    sizes = [sum(p[0] for p in w) for w in final]
    assert all(s & (s - 1) == 0 for s in sizes[:-1]) and sizes == sorted(sizes, reverse=True)
    seen = sorted((doc, start + i) for w in windows + final for n, doc, start in w for i in range(n))
    assert seen == [(d, i) for d, n in enumerate(lengths) for i in range(n)]


def test_short_documents_go_to_short_windows_and_fill_gaps_of_long_ones():
    windows, rest = packing.pack([3, 6, 2, 3], (8, 4))
    assert windows[0] == [(6, 1, 0), (2, 2, 0)] and sorted(len(w) for w in windows) == [2, 2]


def test_step_groups_are_even():
    windows = [[(n, 0, 0)] for n in [4096] * 30 + [2048] * 40 + [512] * 80]
    groups = packing.step_groups(windows)
    filled = {}
    for w, g in zip(windows, groups):
        filled[g] = filled.get(g, 0) + w[0][0]
    assert max(filled.values()) - min(filled.values()) <= 512


# -- packing ---------------------------------------------------------------------------------------------------------


def check_pieces(rows, docs, encode):
    want = {}
    for r in docs:
        ids = [*encode(r[1] or ""), 2]
        want.setdefault((r[0], len(ids)), []).append(ids)
    got = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
    assert got.keys() == want.keys()
    for key, texts in want.items():
        assert sorted(t for _, x in got[key] for t in x) == sorted(t for x in texts for t in x)
        if len(texts) == 1:
            at = 0
            for start, ids in sorted(got[key]):
                assert start == at and ids == texts[0][at : at + len(ids)]
                at += len(ids)
            assert at == len(texts[0])
    sequences = {}
    for r in rows:
        sequences.setdefault((r.sequence_id, r.window), []).append((r.offset, r.length))
    for (_, window), parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and window == (at if at & (at - 1) == 0 else 4096)


def test_pieces_hold_the_tokenizers_ids(spark, docs):
    encode = packing.PieceTokenizer(WORDS)
    rows = packing.pack_documents(docs, WORDS).collect()
    check_pieces(rows, corpus(), lambda t: encode.tokenizer.encode(t, add_special_tokens=False).ids)


def test_packing_in_small_blocks_and_tiers(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 500)
    encode = packing.PieceTokenizer(WORDS)
    odd = [(i, t) for i, t in enumerate(ODD * 40)]
    rows = packing.pack_documents(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), WORDS, tiers=(64, 16)).collect()
    assert {r.window for r in rows} <= {64, 32, 16, 8, 4, 2, 1}
    assert sum(r.length for r in rows) == sum(len(encode.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in odd)


def test_piece_tokenizer_equals_the_library(monkeypatch):
    encode = packing.PieceTokenizer(WORDS)
    monkeypatch.setattr(packing, "CACHED_PIECES", 50)
    texts = [r[1] or "" for r in corpus()] + ODD
    for first in range(0, len(texts), 7):
        part = texts[first : first + 7]
        assert [x.tolist() for x in encode([t.encode() for t in part])] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def test_plain_texts_are_told_by_their_bytes(spark):
    encode = packing.PieceTokenizer(WORDS)
    plain = re.compile(f"(?!.*<\\|)[{encode.PLAIN}]*", re.DOTALL).fullmatch
    texts = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["a<|b", "a<é|b", "é<", "naïve Ünder € –\n\t", "naïve \x1c"] + [r[1] or "" for r in corpus()] + ODD
    assert [encode.is_plain(t.encode(), t) for t in texts] == [plain(t) is not None for t in texts]
    broken = b"\xc3a\xa9"  # not UTF-8, though its bytes beyond ASCII are a plain character
    assert not encode.is_plain(broken, broken.decode("utf-8", "replace"))


def test_remembered_pieces_change_no_id(spark):
    rows = [(r[0], r[1]) for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few, many = (packing.pack_documents(docs, WORDS, cached_pieces=n).collect() for n in (20, 50_000))
    assert few == many and packing.PieceTokenizer(WORDS, 20).known.limit == 20


# -- pieces ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return pieces.MergeEncoder(PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abeinrst THE\n▁.,é日\U0001f600\t0<>x "), max_size=60))
def test_agenda_equals_the_library(text):
    one = test_agenda_equals_the_library.__dict__.setdefault("encoder", pieces.MergeEncoder(PIECES))
    assert one([text])[0][0] == one.library.encode(text)


def test_ties_go_to_the_left(encoder):
    for text in ("aaaaaaa", "=" * 37, " " * 21 + "x", "ababababab", "0" * 50):
        assert encoder([text])[0][0] == encoder.library.encode(text)


def test_parts_are_encoded_together_as_one_by_one(encoder, monkeypatch):
    """New parts of a batch share their steps; only long ones have an agenda of their own."""
    rng = random.Random(8)
    parts = list({"".join(rng.choice("aabeilnrst▁▁éßzÅ中\U0001f600-.0\t") for _ in range(rng.randint(1, 40))) for _ in range(2000)} | {"a", "▁", "\U0001f600", "\n", "▁the"})
    one_by_one = [pieces.packed(encoder.encode_part(p)) for p in parts]
    alone = []
    monkeypatch.setattr(encoder, "encode_part", lambda p, own=encoder.encode_part: alone.append(p) or own(p))
    assert encoder.encode_parts(parts) == one_by_one and encoder.encode_parts([]) == []
    assert sorted(alone) == sorted(p for p in parts if len(p) > pieces.SHORT_PART) and alone
    short = [p for p in parts if len(p) <= pieces.SHORT_PART]
    alone.clear()
    monkeypatch.setattr(encoder, "known", type(encoder.known)(10))
    encoder.learn(short)
    assert set(alone) == {"\n", "▁"}  # what stands between the parts in the check against the library


def test_encoded_documents(docs, encoder):
    def row(r):
        ids = encoder.library.encode(r[1] or "")
        text = encoder.library.decode(ids) if ids else ""
        return r[0], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)), ids, text

    got = pieces.encode_documents(docs, PIECES).collect()
    assert ordered((*r[:4], list(r[4]), r[5]) for r in got) == ordered(row(r) for r in corpus())


def test_a_wrong_agenda_is_noticed(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "encode_part", lambda part: [5])
    monkeypatch.setattr(encoder, "known", type(encoder.known)(10))
    with pytest.raises(ValueError):
        encoder(["some words"])


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS_DDL)
    assert packing.pack_documents(none, WORDS).collect() == [] and pieces.encode_documents(none, PIECES).collect() == []


def test_long_documents_are_cut_at_full_windows(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(20000))
    rows = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORDS, with_ids=False).collect()
    assert sum(r.length == 4096 for r in rows) >= 4 and sum(r.length for r in rows) == rows[0].doc_tokens
