"""Spark ML's random forest of two classes, grown in another order of work.

Spark ML takes each row through all trees, so that every row touches one place of the histograms of each tree. Here rows are
binned once, a byte a value, and kept in blocks; a block goes through one tree after the other, whose histograms stay in the
processor's cache. Each level is one pass over all blocks for all trees, then one group per tree that adds up the blocks'
counts and chooses the splits. A task holds one batch of blocks and the counts of the features that are tried.

The trees are those of Spark ML: Poisson bootstrap of the rows by tree, a random subset of the encoded features by node, up to
``maxBins`` bins a number by the same rule, Gini gain of weighted classes, least rows of a leaf, the same order among equal
gains, and equal leaves merged. Without the bootstrap and with all features the forest is equal node by node; otherwise the
random numbers are others (``test_model.py``). Bins come from the values of all rows, not from a sample.
"""

from __future__ import annotations

import json
import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from opslens.session import drop_at_end, run_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package installed

#: Rows of a block, and bytes of the Arrow batches in which blocks are read.
BLOCK_ROWS, BATCH_BYTES = 1 << 17, 4 * 1024**2
#: Columns are counted together, or walked through together, as long as their table has at most so many cells.
COUNT_CELLS, WALK_CELLS = 1 << 15, 1 << 13
#: Levels below which only the columns that a tree tries are counted, each on its own; below, nearly all of them are.
FEW_NODES = 3
#: Most levels and encoded features of a forest that is grown here: they bound the counts of a task.
MOST_LEVELS, MOST_FEATURES = 8, 2048
#: Distinct values of a number up to which its bins follow exact counts; beyond, ranks are right to a few parts in so many.
VALUES = 4096
WORD_LEVELS = 6  # nodes of this level have a bit each in a word

#: Poisson numbers of mean 1, each as often among 65,536 as it is likely (to 1 in 131,072).
_TIMES = np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.rint(65536 * np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])).astype(int), prepend=0))
_SPLIT = np.dtype([("node", "i4"), ("feature", "i4"), ("cut", "i4"), ("inside", "?"), ("gain", "f8"), ("left", "i8", 2), ("total", "i8", 2)])
_NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double,
  leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""
#: Parameters of a forest that its trees do not have.
_OF_FORESTS = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")


@dataclass(frozen=True)
class Shape:
    """What the tasks know of a forest. The first ``categories`` columns are codes of which each is a feature of its own, the
    others are bins of a number, which is one feature."""

    trees: int
    depth: int
    min_leaf: int
    seed: int
    tried: int
    bootstrap: bool
    widths: tuple[int, ...]
    firsts: tuple[int, ...]
    categories: int
    features: int
    weights: tuple[float, float]


@dataclass(frozen=True)
class Grown:
    """The splits so far, by tree and heap index of the node; a feature of -1 is none."""

    feature: np.ndarray
    cut: np.ndarray
    inside: np.ndarray


def can_grow(pipeline: Pipeline, weights: dict[float, float]) -> bool:
    """Whether this forest may be grown here: two classes, and parameters that the module knows."""
    forest: RandomForestClassifier = pipeline.getStages()[-1]
    return (
        sorted(weights) == [0.0, 1.0] and forest.getMaxDepth() <= MOST_LEVELS and forest.getFeatureSubsetStrategy() in ("sqrt", "all")
        and forest.getSubsamplingRate() == 1.0 and forest.getImpurity() == "gini" and forest.getMinInfoGain() == 0.0 and forest.getMinWeightFractionPerNode() == 0.0
    )


def fit(pipeline: Pipeline, train: DataFrame, weights: dict[float, float]) -> PipelineModel | None:
    """The fitted pipeline, its forest grown by blocks; None if it has too many features for that. ``weights`` gives the weight
    of each class."""
    *before, forest = pipeline.getStages()
    head = Pipeline(stages=before).fit(train)
    label, inputs = forest.getLabelCol(), before[-1].getInputCols()
    codes, known, sizes = _categories(head)
    numbers = inputs[len(codes) :]
    firsts = [0, *np.cumsum([*sizes, *[1] * len(numbers)]).tolist()]
    if firsts[-1] > MOST_FEATURES:
        return None
    rows = head.transform(train).select(*codes, *[F.col(c).cast("double") for c in (*numbers, label)])
    per_class = (weights[0.0], weights[1.0])
    with _arrow_batches(train.sparkSession):
        cuts = _cut_points(rows.select(*numbers, label), len(numbers), per_class, forest.getMaxBins())
        shape = Shape(
            forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed(),
            firsts[-1] if forest.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(firsts[-1])), forest.getBootstrap(),
            (*known, *[len(c) + 1 for c in cuts]), tuple(firsts[:-1]), len(codes), firsts[-1], per_class,
        )
        grown, gain, counts, tried = _grow(_blocks(rows, shape, cuts), shape)
    trees = [_tree(shape, cuts, *[x[t] for x in (grown.feature, grown.cut, grown.inside, gain, counts, tried)]) for t in range(shape.trees)]
    return PipelineModel(stages=[*head.stages, _model(train.sparkSession, forest, shape, trees)])


def _categories(head: PipelineModel) -> tuple[list[str], list[int], list[int]]:
    """Index columns of the categories, their codes (with the one of unknown categories), and their encoded features."""
    indexers = [s for s in head.stages if isinstance(s, StringIndexerModel)]
    encoders = [s for s in head.stages if isinstance(s, OneHotEncoderModel)]
    if not indexers:
        return [], [], []
    known = [len(labels) + 1 for labels in indexers[0].labelsArray]
    return list(indexers[0].getOutputCols()), known, [int(n) + 1 for n in encoders[0].categorySizes]


@contextmanager
def _arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the bytes of Arrow batches, because a block is one value."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- bins ---------------------------------------------------------------------------------------------------


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray]], most: int = VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with the sum of their weights; more than ``most`` are thinned to parts of even weight, each under its
    greatest value."""
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    weights = np.bincount(place, weights=np.concatenate([w for _, w in parts]), minlength=len(values))
    if len(values) <= most:
        return values, weights
    upto = np.cumsum(weights)
    part = np.minimum(upto * (most / upto[-1]), most - 1).astype(np.int64)
    ends = np.flatnonzero(np.diff(part, append=most))
    return values[ends], np.diff(upto[ends], prepend=0.0)


def _bins(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Spark ML's rule: between all values if they are few, else where the weight so far is nearest to the next even share."""
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) < bins:
        return between
    upto, stride, found = np.cumsum(weights), weights.sum() / bins, []
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def _cut_points(rows: DataFrame, columns: int, weights: tuple[float, float], bins: int) -> list[np.ndarray]:
    """Cut points of each number. Values are merged pairwise, so each is thinned once for every doubling of the rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(columns)]  # for each number (batches, summary), of falling size
        for batch in batches:
            *numbers, label = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1 and must not be null")
            weight = np.where(label == 1.0, weights[1], weights[0])
            for own, x in zip(held, numbers, strict=True):
                if not np.isfinite(x).all():
                    raise ValueError("inputs must not be null, NaN or infinite")
                own.append((1, _merged([(x, weight)])))
                while len(own) > 1 and own[-1][0] == own[-2][0]:
                    (n, a), (_, b) = own.pop(), own.pop()
                    own.append((2 * n, _merged([a, b])))
        merged = [_merged([x for _, x in own]) for own in held if own]
        out = [list(range(len(merged))), [v.tobytes() for v, _ in merged], [w.tobytes() for _, w in merged]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["number", "values", "weights"])

    def unite(table: pa.Table) -> pa.Table:
        parts = [tuple(np.frombuffer(x) for x in pair) for pair in zip(*(table[c].to_pylist() for c in ("values", "weights")), strict=True)]
        found = _bins(*_merged(parts), bins)
        return pa.table({"number": table["number"][:1], "cuts": pa.array([found.tobytes()], pa.binary())})

    summaries = rows.mapInArrow(run, "number int, values binary, weights binary")
    found = {r.number: np.frombuffer(r.cuts) for r in summaries.groupBy("number").applyInArrow(unite, "number int, cuts binary").collect()}
    return [found[i] for i in range(columns)]


def _blocks(rows: DataFrame, shape: Shape, cuts: list[np.ndarray]) -> DataFrame:
    """Binned rows, column by column with the label as the last one; a block is known by its partition and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(codes: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([np.ascontiguousarray(codes).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "place", "codes"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(_binned(columns, shape, cuts))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                whole = np.concatenate(held, axis=1)
                while n >= BLOCK_ROWS:
                    yield block(whole[:, :BLOCK_ROWS])
                    whole, n, place = whole[:, BLOCK_ROWS:], n - BLOCK_ROWS, place + 1
                held = [whole]
        if n:
            yield block(np.concatenate(held, axis=1))

    return stored(rows.mapInArrow(run, "part int, place int, codes binary"))


def _binned(columns: list[np.ndarray], shape: Shape, cuts: list[np.ndarray]) -> np.ndarray:
    """The codes of rows, column by column; further columns, as the label, as they are."""
    codes = np.empty((len(columns), len(columns[0])), _code_type(shape))
    for i, x in enumerate(columns):
        number = i - shape.categories
        codes[i] = np.searchsorted(cuts[number], x) if 0 <= number < len(cuts) else x
    return codes


def _code_type(shape: Shape) -> np.dtype:
    return np.dtype(np.uint8 if max(shape.widths, default=0) <= 256 else np.uint16)


# --- levels ---------------------------------------------------------------------------------------------------


def _grow(blocks: DataFrame, shape: Shape) -> tuple[Grown, np.ndarray, np.ndarray, np.ndarray]:
    """All splits, their gains, the rows of each class at each node, and whether splits were tried there."""
    size = (shape.trees, 2 << shape.depth)
    grown = Grown(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, bool))
    gain, counts, tried = np.full(size, -np.inf), np.zeros((*size, 2), np.int64), np.zeros(size, bool)
    active = np.ones((shape.trees, 1), bool)
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    for level in range(shape.depth):
        if not active.any():
            break
        first = 1 << level
        per_block = blocks.repartition(tasks).mapInArrow(_counting(shape, level, grown, active), "tree int, counts binary")
        choosing = _choosing(shape, level, active, counts[:, first : 2 * first])
        now, active = active, np.zeros((shape.trees, 2 * first), bool)
        for tree, data in per_block.groupBy("tree").applyInArrow(choosing, "tree int, splits binary").collect():
            found = np.frombuffer(data, _SPLIT)
            at = first + found["node"]
            counts[tree, at], gain[tree, at], tried[tree, at] = found["total"], found["gain"], True
            split = found[found["gain"] > 0]
            at = first + split["node"]
            grown.feature[tree, at], grown.cut[tree, at], grown.inside[tree, at] = split["feature"], split["cut"], split["inside"]
            for side, rows in enumerate((split["left"], split["total"] - split["left"])):
                counts[tree, 2 * at + side] = rows
                active[tree, 2 * split["node"] + side] = _gini(rows * np.array(shape.weights)) >= np.finfo(float).eps
        assert (tried[:, first : 2 * first] == now).all()
    return grown, gain, counts, tried


def _gini(weighted: np.ndarray) -> np.ndarray:
    total = weighted[..., 0] + weighted[..., 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = weighted[..., 0] / total, weighted[..., 1] / total
    return np.where(total == 0, 0.0, 1.0 - a * a - b * b)


def _wanted(shape: Shape, level: int, tree: int, active: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each column the active nodes that try it, the place of the feature among those that the node tries, and its code."""
    size = (1 << level, shape.features)
    if shape.tried < shape.features:
        rng = np.random.Generator(np.random.PCG64([shape.seed & 0xFFFFFFFFFFFFFFFF, 1, tree, level]))
        features = rng.random(size).argsort(axis=1)[:, : shape.tried]
    else:
        features = np.broadcast_to(np.arange(shape.features), size)
    nodes = np.repeat(np.flatnonzero(active), features.shape[1])
    order = np.tile(np.arange(features.shape[1]), len(nodes) // features.shape[1])
    features = features[nodes, order]
    column = np.searchsorted(shape.firsts, features, side="right") - 1
    found = []
    for j, first in enumerate(shape.firsts):
        here = np.flatnonzero((column == j) & ((j >= shape.categories) | (features - first < shape.widths[j])))
        found.append((nodes[here], order[here], features[here] - first))
    return found


def _packed(widths: Sequence[int], most: int) -> list[list[int]]:
    """Columns in groups of at most ``most`` joint codes, a wider column alone."""
    groups: list[list[int]] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        fits = (g for g in groups if math.prod(widths[i] for i in g) * widths[j] <= most)
        if (group := next(fits, None)) is None:
            groups.append([j])
        else:
            group.append(j)
    return groups


def _joint(codes: np.ndarray, group: Sequence[int], widths: Sequence[int]) -> np.ndarray:
    out = codes[group[0]].astype(np.int64)
    for j in group[1:]:
        out *= widths[j]
        out += codes[j]
    return out


def _goes_left(shape: Shape, feature: int, cut: int, inside: bool) -> tuple[int, np.ndarray]:
    """Column of a split, and for each of its codes whether rows go left."""
    j = int(np.searchsorted(shape.firsts, feature, side="right")) - 1
    codes = np.arange(shape.widths[j])
    if j >= shape.categories:
        return j, codes <= cut
    return j, (codes == feature - shape.firsts[j]) == inside


class _Walk:
    """Finds the nodes of a level that a block's rows have reached in a tree.

    Down to level ``WORD_LEVELS`` each split is a word for each code of its column, with the bits of the nodes that remain
    within reach; the words of all columns leave those below the row's place. Further levels are stepped through.
    """

    def __init__(self, shape: Shape, level: int, groups: list[list[int]], grown: Grown, tree: int):
        words = min(level, WORD_LEVELS)
        every = (1 << (1 << words)) - 1
        by_column: dict[int, np.ndarray] = {}
        for h in np.flatnonzero(grown.feature[tree, : 1 << words] >= 0).tolist():
            j, left = _goes_left(shape, int(grown.feature[tree, h]), int(grown.cut[tree, h]), bool(grown.inside[tree, h]))
            own = h.bit_length() - 1
            half = 1 << (words - own - 1)
            low = ((1 << half) - 1) << ((h - (1 << own)) * 2 * half)
            keep = by_column.setdefault(j, np.full(shape.widths[j], every, np.uint64))
            keep &= np.where(left, np.uint64(every ^ (low << half)), np.uint64(every ^ low))
        self.tables = []
        for g, group in enumerate(groups):
            if any(j in by_column for j in group):
                table = np.full(1, every, np.uint64)
                for j in group:
                    table = (table[:, None] & by_column.get(j, np.full(shape.widths[j], every, np.uint64))).ravel()
                self.tables.append((g, table))
        self.steps = []
        for above in range(words, level):
            width = max(shape.widths)
            column, to = np.zeros(1 << above, np.int64), np.repeat(2 * np.arange(1 << above), width).reshape(-1, width)
            for node in np.flatnonzero(grown.feature[tree, 1 << above : 2 << above] >= 0).tolist():
                h = (1 << above) + node
                column[node], left = _goes_left(shape, int(grown.feature[tree, h]), int(grown.cut[tree, h]), bool(grown.inside[tree, h]))
                to[node, : len(left)] += ~left
            self.steps.append((column, np.arange(1 << above) * width, to.ravel()))

    def nodes(self, block: _Block) -> np.ndarray:
        node, a, b = block.node, block.a, block.b
        if not self.tables:
            node[:] = 0
        else:
            (g, table), *others = self.tables
            x, y = a.view(np.uint64), b.view(np.uint64)
            np.take(table, block.walked[g], out=x, mode="wrap")
            for g, table in others:
                np.take(table, block.walked[g], out=y, mode="wrap")
                np.bitwise_and(x, y, out=x)
            np.negative(a, out=b)
            np.bitwise_and(x, y, out=x)  # the lowest bit: the row's node, or the first below the leaf that it ended in
            np.subtract(x, np.uint64(1), out=x)
            np.bitwise_count(x, out=block.bits)
            np.copyto(node, block.bits)
        for column, start, to in self.steps:
            np.take(column * block.n, node, out=a, mode="wrap")
            np.add(a, block.rows, out=a)
            np.take(block.flat, a, out=block.code, mode="wrap")
            np.take(start, node, out=b, mode="wrap")
            np.add(b, block.code, out=b)
            np.take(to, b, out=node, mode="wrap")
        return node


class _Block:
    """A block's codes, column by column, as a walk needs them, and room for its steps."""

    def __init__(self, codes: np.ndarray, shape: Shape, walked: list[list[int]]):
        self.n = n = codes.shape[1]
        self.flat, self.rows = codes.reshape(-1), np.arange(n)
        self.walked = [_joint(codes, g, shape.widths) for g in walked]
        self.node, self.a, self.b = (np.empty(n, np.int64) for _ in range(3))
        self.bits, self.code, self.times = np.empty(n, np.uint8), np.empty(n, codes.dtype), np.ones(n)


def _bag(shape: Shape, tree: int, part: int, place: int, block: _Block) -> np.ndarray:
    """How often each row of a block is in the tree's sample, the same in all passes."""
    if shape.bootstrap:
        rng = np.random.Generator(np.random.SFC64([shape.seed & 0xFFFFFFFFFFFFFFFF, 0, tree, part, place]))
        np.copyto(block.a, rng.integers(0, 1 << 64, block.n // 4 + 1, np.uint64).view(np.uint16)[: block.n])
        np.take(_TIMES, block.a, out=block.bits, mode="wrap")
        np.copyto(block.times, block.bits)
    return block.times


def _counting(shape: Shape, level: int, grown: Grown, active: np.ndarray):
    """For each tree the rows by class of what its nodes try: for a code of a category those that have it, for a number those
    in each bin, column after column; at the root all rows first."""
    nodes = 1 << level
    walked = _packed(shape.widths, WALK_CELLS)
    counted = _packed(shape.widths, 1 if level < FEW_NODES else COUNT_CELLS // (2 * nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.flatnonzero(active.any(axis=1)).tolist()
        plans = []
        for t in trees:
            wanted = _wanted(shape, level, t, active[t])
            sums = [np.zeros((len(n), 2) if j < shape.categories else (shape.widths[j], 2, len(n))) for j, (n, _, _) in enumerate(wanted)]
            groups = [(g, group) for g, group in enumerate(counted) if any(len(wanted[j][0]) for j in group)]
            plans.append((t, _Walk(shape, level, walked, grown, t) if level else None, wanted, groups, sums, np.zeros(2)))
        for batch in batches:
            for part, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *codes, label = np.frombuffer(data, _code_type(shape)).reshape(len(shape.widths) + 1, -1)
                label = label.astype(np.int64)
                block = _Block(np.array(codes), shape, walked if level else [])
                cells = [(_joint(codes, g, shape.widths) * 2 + label) << level for g in counted]
                for t, walk, wanted, groups, sums, total in plans:
                    times = _bag(shape, t, part, place, block)
                    if walk is None:
                        total += np.bincount(label, weights=times, minlength=2)
                    else:
                        node = walk.nodes(block)
                    for g, group in groups:
                        cell = cells[g] if walk is None else np.add(cells[g], node, out=block.a)
                        widths = [shape.widths[j] for j in group]
                        table = np.bincount(cell, weights=times, minlength=math.prod(widths) * 2 * nodes).reshape(*widths, 2, nodes)
                        for k, j in enumerate(group):
                            at, _, code = wanted[j]
                            others = tuple(i for i in range(len(group)) if i != k)
                            if j < shape.categories:
                                sums[j] += (table.sum(axis=others) if others else table)[code, :, at]
                            elif len(at):
                                own = table if len(at) == nodes else table.take(at, axis=-1)
                                sums[j] += own.sum(axis=others) if others else own
        for start in range(0, len(plans), 16):
            own = plans[start : start + 16]
            data = [np.concatenate([total if level == 0 else total[:0], *[s.ravel() for s in sums]]).astype(np.int64).tobytes() for *_, sums, total in own]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in own], pa.int32()), pa.array(data, pa.binary())], ["tree", "counts"])

    return run


def _choosing(shape: Shape, level: int, active: np.ndarray, totals: np.ndarray):
    """The best split of each active node of a tree, from all tasks' counts."""
    weights = np.array(shape.weights)

    def gains(left: np.ndarray, total: np.ndarray) -> np.ndarray:
        right = total - left
        a, b = left * weights, right * weights
        whole, on_left, on_right = (x[..., 0] + x[..., 1] for x in (a + b, a, b))
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = _gini(a + b) - on_left / whole * _gini(a) - on_right / whole * _gini(b)
        enough = (left.sum(axis=-1) >= shape.min_leaf) & (right.sum(axis=-1) >= shape.min_leaf)
        return np.where(enough & (gain >= 0), gain, -np.inf)

    def run(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        counts = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        total, at = totals[tree], 0
        if level == 0:
            total, at = counts[:2][None], 2
        size = (1 << level, shape.tried)
        gain, cut, inside, left = np.full(size, -np.inf), np.zeros(size, np.int32), np.zeros(size, bool), np.zeros((*size, 2), np.int64)
        feature = np.zeros(size, np.int32)
        for j, (nodes, order, code) in enumerate(_wanted(shape, level, tree, active[tree])):
            here, n, all_rows = (nodes, order), len(nodes), total[nodes]
            feature[here] = shape.firsts[j] + code
            if j < shape.categories:
                own = counts[at : at + 2 * n].reshape(n, 2)
                at += 2 * n
                # the side with less weight of the second class is the left one
                second = [np.where(x.sum(axis=1) > 0, x[:, 1] * weights[1], np.inf) for x in (own, all_rows - own)]
                inside[here] = second[0] < second[1]
                left[here] = np.where(inside[here][:, None], own, all_rows - own)
                gain[here] = gains(left[here], all_rows)
            else:
                width = shape.widths[j]
                own = counts[at : at + 2 * n * width].reshape(width, 2, n)
                at += 2 * n * width
                if n and width > 1:
                    upto = own.cumsum(axis=0)[:-1].transpose(0, 2, 1)
                    each = gains(upto, all_rows)
                    best = each.argmax(axis=0)
                    cut[here], gain[here], left[here] = best, each[best, np.arange(n)], upto[best, np.arange(n)]
        nodes = np.flatnonzero(active[tree])
        best = gain[nodes].argmax(axis=1)
        out = np.zeros(len(nodes), _SPLIT)
        out["node"], out["total"] = nodes, total[nodes]
        for name, x in (("feature", feature), ("cut", cut), ("inside", inside), ("gain", gain), ("left", left)):
            out[name] = x[nodes, best]
        return pa.table({"tree": pa.array([tree], pa.int32()), "splits": pa.array([out.tobytes()], pa.binary())})

    return run


# --- scores ---------------------------------------------------------------------------------------------------


def can_score(model: PipelineModel) -> bool:
    """Whether ``scored`` knows the model: an assembler and a forest of two classes at the end, of few levels."""
    if len(model.stages) < 2 or not isinstance(model.stages[-1], RandomForestClassificationModel) or not isinstance(model.stages[-2], VectorAssembler):
        return False
    return model.stages[-1].numClasses == 2 and model.stages[-1].getMaxDepth() <= MOST_LEVELS


def scored(model: PipelineModel, df: DataFrame, score: str = "score") -> DataFrame:
    """The rows with the probability of the second class, the same bits as Spark ML's: a batch of rows goes through one tree
    after the other."""
    *before, forest = model.stages
    head = PipelineModel(stages=before)
    codes, known, sizes = _categories(head)
    numbers = before[-1].getInputCols()[len(codes) :]
    firsts = [0, *np.cumsum([*sizes, *[1] * len(numbers)]).tolist()]
    trees = _saved_trees(df.sparkSession, forest)
    cuts = [np.unique([x["split"][1][0] for tree in trees for x in tree if x["split"][0] == f]) for f in firsts[len(codes) : -1]]
    levels = max(_depth(tree) for tree in trees)
    shape = Shape(len(trees), levels, 0, 0, 0, False, (*known, *[len(c) + 1 for c in cuts]), tuple(firsts[:-1]), len(codes), firsts[-1], (1.0, 1.0))
    grown, shares = _grown(trees, shape, cuts)
    walked, names = _packed(shape.widths, WALK_CELLS), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [_Walk(shape, levels, walked, grown, t) for t in range(shape.trees)]
        for batch in batches:
            columns = [batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) for name in (*codes, *numbers)]
            block = _Block(_binned(columns, shape, cuts), shape, walked)
            votes, one = np.zeros((2, block.n)), np.empty(block.n)
            for walk, share in zip(walks, shares, strict=True):
                node = walk.nodes(block)
                for own, by_class in zip(votes, share, strict=True):
                    np.take(by_class, node, out=one, mode="wrap")
                    own += one
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(votes[1] / (votes[0] + votes[1]))], [*names, score])

    rows = head.transform(df).select(*names, *codes)
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField(score, DoubleType())]))


def _saved_trees(spark: SparkSession, forest: RandomForestClassificationModel) -> list[list[dict]]:
    """The nodes of each tree as Spark ML saves them, in the order of their numbers."""
    path = f"{run_path(spark)}/forest-{uuid.uuid4().hex}"
    forest.save(path)
    drop_at_end(spark)
    trees: list[list[dict]] = [[] for _ in range(forest.getNumTrees)]
    part = "nodeData.{}".format
    split = F.struct(part("split.featureIndex"), part("split.leftCategoriesOrThreshold"))
    nodes = spark.read.parquet(f"{path}/data").select("treeID", *map(part, ("id", "leftChild", "rightChild", "impurityStats")), split.alias("split"))
    for tree, *values in nodes.collect():
        trees[tree].append(dict(zip(("id", "left", "right", "stats", "split"), values, strict=True)))
    return [sorted(tree, key=lambda x: x["id"]) for tree in trees]


def _depth(tree: list[dict], node: int = 0) -> int:
    return 0 if tree[node]["left"] < 0 else 1 + max(_depth(tree, tree[node][side]) for side in ("left", "right"))


def _grown(trees: list[list[dict]], shape: Shape, cuts: list[np.ndarray]) -> tuple[Grown, np.ndarray]:
    """The splits of saved trees, and by tree and class the shares of the leaf that each place of the last level is in."""
    size = (shape.trees, 1 << shape.depth)
    grown = Grown(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, bool))
    shares = np.zeros((shape.trees, 2, 1 << shape.depth))

    def fill(t: int, node: int, h: int, level: int) -> None:
        x = trees[t][node]
        if x["left"] < 0:
            total = sum(x["stats"])
            # rows stop at the first place below a leaf
            shares[t, :, (h << shape.depth - level) - (1 << shape.depth)] = [s / total if total else 0.0 for s in x["stats"]]
            return
        grown.feature[t, h], (first, *_) = x["split"]
        j = int(np.searchsorted(shape.firsts, x["split"][0], side="right")) - 1
        if j < shape.categories:
            grown.inside[t, h] = first == 1.0
        else:
            grown.cut[t, h] = np.searchsorted(cuts[j - shape.categories], first)
        fill(t, x["left"], 2 * h, level + 1)
        fill(t, x["right"], 2 * h + 1, level + 1)

    for t in range(shape.trees):
        fill(t, 0, 1, 0)
    return grown, shares


# --- the model ------------------------------------------------------------------------------------------------


def _tree(
    shape: Shape, cuts: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, inside: np.ndarray, gain: np.ndarray, counts: np.ndarray, tried: np.ndarray
) -> list[tuple]:
    """A tree's nodes as Spark ML saves them, from the root on; two leaves with the same prediction become one."""
    weighted = counts * np.array(shape.weights)
    gini, prediction = _gini(weighted), weighted.argmax(axis=-1)

    def node(h: int) -> list[tuple]:
        leaf = (float(prediction[h]), -1.0 if tried[h] and gain[h] == -np.inf else float(gini[h]), weighted[h].tolist(), int(counts[h].sum()))
        if feature[h] < 0:
            return [(*leaf, -1.0, -1, -1, (-1, [], -1))]
        left, right = node(2 * h), node(2 * h + 1)
        if len(left) == len(right) == 1 and left[0][0] == right[0][0]:
            return [(*leaf, -1.0, -1, -1, (-1, [], -1))]
        f = int(feature[h])
        j = int(np.searchsorted(shape.firsts, f, side="right")) - 1
        split = (f, [float(inside[h])], 2) if j < shape.categories else (f, [float(cuts[j - shape.categories][cut[h]])], -1)
        moved = [[(*x[:5], *[c + by if c >= 0 else c for c in x[5:7]], x[7]) for x in side] for side, by in ((left, 1), (right, 1 + len(left)))]
        return [(*leaf, float(gain[h]), 1, 1 + len(left), split), *moved[0], *moved[1]]

    return [(i, *x) for i, x in enumerate(node(1))]


def _model(spark: SparkSession, forest: RandomForestClassifier, shape: Shape, trees: list[list[tuple]]) -> RandomForestClassificationModel:
    """The trees in the form in which Spark ML saves a forest, and loaded from there."""
    path = f"{run_path(spark)}/forest-{uuid.uuid4().hex}"
    forest.write().save(f"{path}/estimator")
    drop_at_end(spark)
    about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    mine = {"numFeatures": shape.features, "numClasses": 2, "numTrees": shape.trees}
    package = "org.apache.spark.ml.classification"
    own = {k: v for k, v in about["paramMap"].items() if k not in _OF_FORESTS}, {k: v for k, v in about["defaultParamMap"].items() if k not in _OF_FORESTS}
    per_tree = [
        (t, json.dumps(about | {"class": f"{package}.DecisionTreeClassificationModel", "uid": f"dtc_{uuid.uuid4().hex[:12]}", "paramMap": own[0], "defaultParamMap": own[1]}), 1.0)
        for t in range(shape.trees)
    ]
    text = json.dumps(about | mine | {"class": f"{package}.RandomForestClassificationModel", "sparkVersion": pyspark.__version__})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(per_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    nodes = [(t, x) for t, tree in enumerate(trees) for x in tree]
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{path}/model/data")
    return RandomForestClassificationModel.load(f"{path}/model")
