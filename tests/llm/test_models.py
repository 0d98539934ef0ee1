"""The manifest, the suffix tree and the conversation trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fixtures import DOCS_DDL, corpus, ordered, prose, sha, words
from opslens.llm import lm, manifest, trie

CLASHING = {"score": "hash", "name": "tree", "spans": "pos", "fp": "size"}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- manifest --------------------------------------------------------------------------------------------------------


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(level):
    """Root, and siblings left and right of each leaf level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 3 * 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
            at[i] = p // 3
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def manifest_rows(rows):
    leaf = lambda r: digest("".join(map(field, r)))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    trees = []
    for name in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", "")) if hit else r)
            for left, right in path + top:
                now = digest(left + now + right)
            proof = digest("".join(left + right for left, right in path + top))
            out.append((r[0], leaf(r), subroot, root, proof, now, now == root))
    return out


def document_fields(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_manifest(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS_DDL).withColumnsRenamed(CLASHING).repartition(parts)
    assert ordered(manifest.manifest(docs).collect()) == ordered(manifest_rows(document_fields(rows)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 727, 729, 730, 731, 2200])
def test_manifest_of_sources_of_any_size(spark, n):
    """Below, at and above a block, alone and beside a hot source and many small ones."""
    rows = [(i, f"a\n{i}", "en", "hot", None) for i in range(n)] + [(i, "b\n", None, f"s{i % 40}", 2) for i in range(n if n < 20 else 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = manifest.manifest(docs).collect()
    assert ordered(got) == ordered(manifest_rows(document_fields(rows)))
    assert {r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 2} <= {True}
    assert {r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 2 == 0} <= {False}


def test_manifest_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, "x", "en", None, 1)] * 800 + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ordered(manifest.manifest(docs).collect()) == ordered(manifest_rows(document_fields(rows)))
    assert manifest.manifest(docs.limit(0)).collect() == []


# -- suffix tree -----------------------------------------------------------------------------------------------------


def lm_rows(rows, share=lm.LEAST_SHARE, least=lm.LEAST_COUNT, depth=lm.DEPTH):
    """Scores of rows ``id, text``, and the sum of some distributions over all words and an unseen one."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), b""]
    learned = [tokens(t) for i, t in rows if not held(i)]
    counts = [Counter(tuple(t[i : i + k]) for t in learned for i in range(len(t) - k + 1)) for k in range(depth + 2)]
    n, v = sum(map(len, learned)), len(counts[1])
    floor = max(least, math.ceil(share * n))
    grams = [{g: c for g, c in x.items() if c >= floor} for x in counts]
    kept = {}

    def p(context, word):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (counts[1].get((word,), 0) + 1) / (n + v + 1)
        listed, rest = kept[context]
        return listed[word] if word in listed else rest * p(context[1:], word)

    for k in range(1, depth + 1):
        new = {}
        for s, c in grams[k].items():
            after = {g[-1]: m for g, m in grams[k + 1].items() if g[:-1] == s}
            if after and (k == 1 or s[1:] in kept):
                own, short = {w: (m - 0.5) / c for w, m in after.items()}, {w: p(s[1:], w) for w in after}
                left = (1 - sum(own.values())) / (1 - sum(short.values()))
                gain = sum(m * math.log(own[w] / short[w]) for w, m in after.items()) + (c - sum(after.values())) * math.log(left)
                if gain > 0.5 * (len(after) + 1) * math.log(max(n, 2)):
                    new[s] = own, left
        kept |= new
    out = []
    for i, t in rows:
        x = tokens(t)
        score = sum(math.log10(p(tuple(x[max(0, j - depth) : j]), w)) for j, w in enumerate(x))
        out.append((i, held(i), len(x), sum((w,) in counts[1] for w in x), n, sum(math.log10(p((), w)) for w in x), score))
    sums = [sum(p(s, w) for (w,) in counts[1]) + p(s, b"never seen") for s in [(), *kept]]
    return out, sums, Counter(map(len, kept))


def assert_scores(got, want):
    got, want = ordered(got), ordered(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-12, atol=1e-9)


def phrases_and_prose(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["the ba no", "A ba lu mir", "to ba lu", "lu a b one", "mi a b two", "ti te no", prose(rng, 2)]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    return [*((i, t) for i, t in enumerate(texts)), *((r[0], r[1]) for r in corpus())]


@pytest.mark.parametrize("parts, bucket_bytes, options", [(1, 1 << 24, {}), (6, 900, {}), (3, 5000, {"least_count": 5, "depth": 2}), (4, 5000, {"least_share": 0.01, "depth": 1})])
def test_scores(spark, parts, bucket_bytes, options):
    rows = phrases_and_prose()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, names string, score double").repartition(parts)
    want, sums, kept = lm_rows(rows, **{k.removeprefix("least_") if k != "least_count" else "least": v for k, v in options.items()})
    assert max(kept) == options.get("depth", 3) and np.allclose(sums, 1)
    assert_scores(lm.score_documents(docs, bucket_bytes=bucket_bytes, **options).collect(), want)


def test_scores_over_several_blocks_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    rows = phrases_and_prose(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    monkeypatch.setattr(lm, "small_batches", lambda df: df)
    assert_scores(lm.score_documents(docs, bucket_bytes=3000).collect(), lm_rows(rows)[0])


def test_passage_that_occurs_twice_in_millions_of_tokens_is_told_by_its_contexts(spark):
    passage = " ".join(f"rare{i}" for i in range(40))
    rows = [(str(i), "lu " * 1100) for i in range(2000)] + [("twice", passage), ("again", passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    found = {r.doc_id: r for r in lm.score_documents(docs, learned=F.lit(True)).where("doc_id in ('twice', 'again')").collect()}
    # every word is followed by the next one in two of two places: (2 - 0.5) / 2
    for r in found.values():
        assert r.train_tokens > 2_200_000 and r.base_score < -200 and r.score > -20


def test_steps_of_the_exchange():
    assert lm.steps(3) == [[1], [2], [3, -1], [-2], [4], [-3]] and lm.steps(2) == [[1], [2], [-1], [3], [-2]] and lm.steps(1) == [[1], [2], [-1]]


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert lm.score_documents(docs).collect() == []
    only_held = spark.createDataFrame([("a", "x y"), ("b", None)], docs.schema)
    assert [tuple(r) for r in lm.score_documents(only_held, learned=F.lit(False)).orderBy("doc_id").collect()] == [("a", True, 3, 0, 0, 0.0, 0.0), ("b", True, 1, 0, 0, 0.0, 0.0)]


def test_tree_tells_held_out_texts_better_than_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm.score_documents(docs).where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("tree")).first()
    assert row.tree / row.n > row.base / row.n + 0.1


def test_lists_of_numbers():
    for values in ([], [0], [5, 2**63, 2**64 - 1], list(range(1000))):
        x = np.array(values, np.uint64)
        assert lm.unpacked(lm.packed(x)).tolist() == values and lm.unpacked_names(lm.packed_names(x)).tolist() == values


def test_lists_of_small_numbers_leave_out_the_upper_bytes():
    assert [lm.packed(np.array(x, np.uint64))[4] for x in ([], [0], [255], [7, 256], [2**63])] == [0, 0, 1, 2, 8]


@pytest.mark.parametrize("names", [[], [3], [2**64 - 1, 0, 2**64 - 1, 0], [5, 4, 7, 4, 5, 6] * 50, [x << 40 for x in (9, 1, 9, 3, 1)]])
def test_order_of_names_that_differ_in_few_bits(names):
    order, now = lm.ranked(np.array(names, np.uint64))
    assert order.tolist() == sorted(range(len(names)), key=lambda i: (names[i], i)) and now.tolist() == sorted(names)


def test_steps_that_need_no_scores_make_none():
    block = lm.block_of(pa.array(["a b a b", None, "b a"]), pa.array([True, False, True]))
    answers = {1: np.full(3, 5, np.uint64)}
    plain, scored = (lm.grams_of(block, answers, 2, 3, 2, 11, x) for x in (False, True))
    assert plain.score is None and np.allclose(scored.score, np.log10(3 / 11)) and scored.base is not scored.score
    assert [x.tolist() for x in plain.at] == [x.tolist() for x in scored.at] and sorted(plain.first[1].tolist()) == [1, 2, 4, 8]


# -- trie ------------------------------------------------------------------------------------------------------------


def trie_rows(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()[:16])
    turns = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    seqs = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out = []
    for s in sorted(members, key=len, reverse=True):
        below, m = kids.get(s, []), members[s]
        leaves[s] = sum(leaves[x] for x in below) or 1
        saved[s] = sum(saved[x] for x in below) + (len(m) - 1) * (len(words(s[-1][1])) if s else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(below), leaves[s], saved[s], sha(ends.encode())))
    return out


TURNS = "conv_id long, turn long, role string, text string, node string, n int, edge int"


def conversations(seed: int, n: int, most: int):
    """Few words and roles, so that beginnings are shared; nulls, ties, repeated rows, a long conversation, copies."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d  e\nf"])))
    rows += [(n + 1, t, "user", "a") for t in range(70)] + [(n + 2, t, "user", "a") for t in range(64)] + [(n + 3, t, "user", "a" if t < 65 else "z") for t in range(90)]
    rows += [(1000 + i, t, "system", "same") for i in range(50) for t in range(3)] + [(2000 + i, 0, "user", prose(rng, 3)) for i in range(60)]
    rows += [(c, None, None, "null turn") for c in (3, 4)] + [(5, 1, None, None), (5, 1, "user", None), (5, 1, "", "")] + rows[:7]
    return [*rows, (None, 1, "user", "lost"), (-5, 1, "user", "a"), (-40, 0, "user", "b c"), (7, 0, "1:u", "ser"), (7, 0, "", "1:user")]


@pytest.mark.parametrize("first, growth, parts", [(4096, 16, 3), (1, 2, 1), (20, 3, 5)])
def test_trie(spark, first, growth, parts):
    rows = conversations(first, 90, 7)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(parts)
    assert ordered(trie.prefix_trie(df, first, growth).collect()) == ordered(trie_rows(rows))


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(none).collect() == []
    # 21 takes at least one turn of the absent 20 and has no turn left
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    for rows in ([(c, 1, "user", "a")], [(c, 1, "user", "a"), (60, 1, "user", "a")], [(60, 1, "user", None)]):
        df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
        assert ordered(trie.prefix_trie(df).collect()) == ordered(trie_rows(rows))


def test_ends_of_a_hot_node_are_hashed_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 7)
    df = spark.range(500).select((F.col("id") % 97 > 3).cast("string").cast("binary").alias("key"), F.col("id").alias("conv_id"))
    got = {bytes(r.key): r.ends_sha256 for r in trie.digests(df).collect()}
    want = {}
    for i in range(500):
        want.setdefault(str(i % 97 > 3).lower().encode(), []).append(str(i))
    assert got == {k: digest(",".join(v)) for k, v in want.items()}


def test_two_fattest_numbers(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)
