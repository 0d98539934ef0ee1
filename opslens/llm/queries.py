"""The numbered operators applied to their whole tables with production parameters, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opslens.llm import html, language, lm, manifest, packing, phrases, pieces, pii, quality, simhash, suffix, topk, trie
from opslens.llm.support import read


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(read(spark, folder, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op3_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, folder, "documents"), with_text=False)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    # alone in its executors, it has room for more pieces than beside the pipeline's other stages
    docs, tokenizer = read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, tokenizer, with_ids=False, cached_pieces=500_000)


def op6_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.remove_passages(read(spark, folder, "documents"), with_text=False)


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(read(spark, folder, "pages"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=False)


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(read(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language.learn(docs.where(~language.held_out()))
    rows = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(read(spark, folder, "documents"))


def op12_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(read(spark, folder, "documents"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(read(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_suffix": op3_suffix,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_phrases": op6_phrases,
    "op7_html": op7_html,
    "op8_pieces": op8_pieces,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_manifest": op11_manifest,
    "op12_lm": op12_lm,
    "op13_trie": op13_trie,
}

#: CRC-32 by its table: ``tab`` for each byte, and the value of the decimal digits of ``{id}``.
_CRC_TABLE = """crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
        )"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, nodes: str) -> str:
    """Levels ``name`` of trees over the nodes ``tree, pos, hash, n``, and what stands beside each node (``name_beside``)."""
    return f"""{name} AS (
            SELECT 0 AS lvl, tree, pos, hash, n FROM {nodes}
            UNION ALL
            SELECT lvl + 1, tree, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 3, n
        ), {name}_beside AS (
            SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
                coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
            FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2, 3
        )"""


def _fold(name: str, tree: str, start: str) -> str:
    """What the rows ``start`` (row, tree, pos, h, proof) become at the root of their tree."""
    return f"""{name} AS (
            SELECT row, 0 AS lvl, tree, pos, h, proof FROM {start}
            UNION ALL
            SELECT f.row, f.lvl + 1, f.tree, f.pos // 3, sha256(b.l || f.h || b.r), f.proof || b.l || b.r
            FROM {name} f JOIN {tree}_beside b ON f.tree = b.tree AND f.lvl = b.lvl AND f.pos = b.pos
        ), {name}_end AS (SELECT row, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM {name} GROUP BY row)"""


ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH parts AS (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL
        ), usable AS (
            SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts
            WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x))
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op4_quality": r"""
        WITH docs AS (
            SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
            FROM documents
        ), windows AS (
            SELECT row, i, list_slice(w, i, i + 4) AS win FROM docs, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
        ), again AS (
            SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1
        ), repeated AS (
            SELECT row, count(DISTINCT i + k) AS r FROM again, unnest(range(0, 5)) AS u(k) GROUP BY row
        ), lined AS (
            SELECT row, count(*) - count(DISTINCT line) AS d
            FROM (SELECT row, unnest(lines) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
        ), measured AS (
            SELECT doc_id, t, len(lines) AS n_lines, CAST(len(w) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
                length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS uppers,
                length(regexp_replace(t, '[^!]+', '', 'g')) AS exclaimed
            FROM docs LEFT JOIN repeated USING (row) LEFT JOIN lined USING (row)
        ), judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                10 * n_symbols > n_words OR word_chars > 12 * n_words OR word_chars < 2 * n_words OR 5 * n_dup_lines > 2 * n_lines
                OR 10 * uppers > 4 * letters OR 2 * letters < word_chars OR 4 * exclaimed > n_words AS rejected
            FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
    """,
    "op11_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE}, leaves AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf,
                CASE WHEN {_CRC.format(id="doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS shown
            FROM documents, crc_table
        ), placed AS (
            SELECT *, leaf AS hash, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
        ), {_tree("low", "placed")}, subroots AS (
            SELECT '' AS tree, tree AS name, hash, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
        ), {_tree("high", "subroots")},
        starts AS (SELECT row, tree, pos, shown AS h, '' AS proof FROM placed), {_fold("folded", "low", "starts")},
        middles AS (SELECT row, s.tree, s.pos, f.h, f.proof FROM folded_end f JOIN placed p USING (row) JOIN subroots s ON s.name = p.tree),
        {_fold("whole", "high", "middles")}
        SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.hash AS verified
        FROM placed p JOIN whole_end w USING (row) JOIN subroots s ON s.name = p.tree, (SELECT hash FROM high WHERE n = 1) r
    """,
    "op13_trie": rf"""
        WITH {_CRC_TABLE}, own AS (
            SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
                sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), taken AS (
            SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {_CRC.format(id="conv_id")} % 4 AS h FROM own, crc_table
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM taken c LEFT JOIN own b ON b.conv_id = c.base
        ), prefixes AS (
            SELECT conv_id, len(turns) = d AS ends, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent FROM rebuilt, unnest(range(len(turns) + 1)) AS u(d)
        ), nodes AS (
            SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM prefixes GROUP BY node, depth
        ), kids AS (
            SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
        ), known AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children,
                CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.node[n.depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS spared
            FROM nodes n LEFT JOIN kids k ON n.node = k.node AND n.depth = k.depth
        ), subtrees AS (
            SELECT node[1:d] AS node, d AS depth, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(spared) AS BIGINT) AS saved_tokens
            FROM known, unnest(range(depth + 1)) AS u(d) GROUP BY 1, 2
        )
        SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, CASE WHEN k.depth > 0 THEN p.conv_id END AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
        FROM known k JOIN subtrees s ON k.node = s.node AND k.depth = s.depth LEFT JOIN nodes p ON p.node = k.parent AND p.depth = k.depth - 1
    """,
}
