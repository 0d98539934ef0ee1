"""Exact top-k search by pivot-table elimination.

For vectors on integer grids, ``2 * <q, x> = |q|^2 + |x|^2 - |q - x|^2``. The table holds the distance of every vector to
each pivot; for any pivot p, ``|q - x| >= | |q - p| - |x - p| |``, so the largest of these differences bounds the distance
from below and the score from above. Candidates are evaluated in the order of their bounds until the next bound is
below the k-th score found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.support import per_batch
from opslens.session import stored

#: Vectors from which pivots are chosen at most, and pivots.
PIVOT_SAMPLE, PIVOTS = 2048, 32
#: Candidates and queries that meet in one task.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
_STEP = 256


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` with ``v = floor(scale * x)``; vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & whole & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v")
    )


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """Pivots for each dimension: vectors far from each other, from a bounded sample that the hash of the row decides."""
    found: dict[int, list] = {}
    for (v,) in vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(sample).collect():
        found.setdefault(len(v), []).append(v)
    out = {}
    for size, rows in found.items():
        x = np.array(rows, np.float64).reshape(len(rows), size)
        chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(pivots, len(x)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[size] = x[chosen]
    return out


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, v, d``: every vector with its distances to the pivots of its dimension (none: an empty list)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d: list = [None] * batch.num_rows
        rows = batch.column(1).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(rows):
            by_size.setdefault(len(v), []).append(i)
        for size, places in by_size.items():
            at = pivots.get(size, np.zeros((0, size)))
            x = np.array([rows[i] for i in places], np.float64).reshape(len(places), size)
            far = np.stack([np.linalg.norm(x - p, axis=1) for p in at], axis=1) if len(at) else np.zeros((len(x), 0))
            for i, row in zip(places, far):
                d[i] = row
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(d, pa.list_(pa.float64()))], ["vec_id", "v", "d"])

    return per_batch(vectors.select("vec_id", "v"), "vec_id long, v array<long>, d array<double>", run)


def search_block(ids: np.ndarray, x: np.ndarray, d: np.ndarray, query_ids: np.ndarray, q: np.ndarray, far: np.ndarray, k: int) -> list[tuple]:
    """``query_id, vec_id, score`` of the k best candidates of each query in one block, ties to smaller ids."""
    found = []
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    for one, v, own in zip(query_ids, q, far):
        square = float((v.astype(np.float64) ** 2).sum())
        bound = np.zeros(len(x))
        for p in range(d.shape[1]):
            np.maximum(bound, np.abs(d[:, p] - own[p]), out=bound)
        # rounded outwards: the distances and squares are floating-point
        bound = (square + norms - bound**2) / 2 + 1e-9 * (square + norms) + 1e-6
        rest = np.flatnonzero(ids != one)
        best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = _STEP
        while len(rest):
            if step < len(rest):
                cut = np.argpartition(-bound[rest], step - 1)
                now, rest = rest[cut[:step]], rest[cut[step:]]
            else:
                now, rest = rest, rest[:0]
            all_ids, scores = np.concatenate([best_ids, ids[now]]), np.concatenate([best_scores, x[now] @ v])
            order = np.lexsort((all_ids, -scores))[:k]
            best_ids, best_scores = all_ids[order], scores[order]
            if len(best_ids) == k:
                rest = rest[bound[rest] >= best_scores[-1]]
            step *= 2
        found += [(int(one), int(i), int(s)) for i, s in zip(best_ids, best_scores)]
    return found


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query, ties to smaller ids.

    Both frames hold ``vec_id, v``. A query's own id is no candidate, and vectors of different dimensions do not meet.
    Repeated rows count once; an id with several vectors gives each of them as a candidate. Queries and candidates are
    dealt into blocks of bounded size by hash, every query block meets every candidate block in one task, and only k
    rows per query and block leave it. Scores must fit a long. An empty side gives an empty result.
    """
    candidates, queries = (x.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).drop("copies") for x in (candidates, queries))
    at = choose_pivots(candidates, pivots)
    table, asked = stored(pivot_table(candidates, at)), stored(pivot_table(queries, at))
    blocks, parts = (max(1, -(-x.count() // size)) for x, size in ((table, candidate_block), (asked, query_block)))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    left = table.select(size, deal(blocks, "vec_id", "v").alias("block"), every(parts).alias("part"), "vec_id", "v", "d")
    right = asked.select(size, every(blocks).alias("block"), deal(parts, "vec_id", "v").alias("part"), "vec_id", "v", "d")

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if have.num_rows and ask.num_rows:
            grid = lambda t, c, kind: np.array(t[c].to_pylist(), kind).reshape(t.num_rows, -1)
            ids = lambda t: t["vec_id"].to_numpy()
            rows = search_block(ids(have), grid(have, "v", np.int64), grid(have, "d", np.float64), ids(ask), grid(ask, "v", np.int64), grid(ask, "d", np.float64), k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    keys = ("size", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
