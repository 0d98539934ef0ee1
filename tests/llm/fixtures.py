"""A small corpus with what real tables hold at their edges, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import xxhash

WORDS = [a + b for a in "ba de fi go lu mi no pa re so ti vu".split() for b in "n r s t la me no".split()]
DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, name string, spans string, score int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Rows of ``DOCS_DDL``: prose, copies, near copies, shared passages, nulls, empty and odd texts, a long text, clashing columns."""
    rng = random.Random(seed)
    passage = prose(rng, 120)
    texts: list = [prose(rng, rng.randint(5, 200)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " extra", texts[2].replace("a", "á")]
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}" for _ in range(5)]
    texts += [prose(rng, 30) + " " + passage[40:700], passage + " " + passage, "ba " * 500, "x" * 3000, "é" * 900]
    texts += [None, None, "", "", " \t\n", "one", "!!! ### %%%", "日本語 テキスト", "a b  c\r\nd\x0be", "\U0001f600 " * 10]
    texts.append(" ".join(prose(rng, 100) + "\n" for _ in range(300)))
    rows = [(i, t, None if t is None or i % 7 == 3 else ("en", "xx")[i % 2], f"s{i % 3}", None if t is None else len(t), i, "n", "s", i) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[5], "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def words(text) -> list[bytes]:
    return WORD.findall((text or "").encode())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(sequences: list, length: int) -> list[list[bool]]:
    """For each sequence which of its symbols a window covers that starts more than once."""
    starts = Counter(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if starts[tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def suffix_rows(rows, length: int) -> list[tuple]:
    data = [(r[1] or "").encode() for r in rows]
    out = []
    for r, b, gone in zip(rows, data, repeats(data, length)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def phrase_rows(rows, window: int) -> list[tuple]:
    data = [words(r[1]) for r in rows]
    return [(r[0], len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g) if not y))) for r, w, g in zip(rows, data, repeats(data, window))]


def fingerprint(text, shingle: int) -> int:
    found = [w for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not found:
        return 0
    grams = [b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(rows, shingle: int, bits: int) -> list[tuple]:
    prints = [fingerprint(r[1], shingle) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
