"""Second-order gradient boosting on Spark (M6): histograms of gradients, level-wise and leaf-wise trees.

Rows are binned once: cuts are quantiles from a mergeable sketch, and each partition becomes one
block of small integers. Features of few bins share a code, so that one count serves them all. A
round fits one tree to the loss's first and second derivatives g and h (logistic loss, weighted).
For every level one Spark job adds up g and h by (node, code) in each task and from these by (node,
feature, bin); the histograms, whose size depends on nodes and bins and not on rows, are merged in a
tree of tasks. A task adds up whole multiples of a small power of two, which is exact in any order:
equal columns have equal sums. The driver picks each node's best split,

    gain = 1/2 (GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)) - gamma,

and a leaf is worth -G / (H + l2) times the learning rate.

* ``level`` growth splits every node that gains, down to ``max_depth``.
* ``leaf`` growth splits the leaf of the largest gain first until the tree has ``num_leaves``. A
  node's gain does not depend on the order, so the levels are expanded as above and the best-first
  choice is then made among their splits: the same tree, with one job for each level.

Several boosters that learn from the same rows share every job. A block is kept with its scores so
far, which are replaced after each round; every ``CHECKPOINT_ROUNDS`` rounds they are written to the
checkpoint folder, so a lost executor costs the rounds since then. RDDs are used because a block is
state for numpy code over many rounds; everything before and after is a DataFrame.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from retentio.operators.tree_shap import NodeTable
from retentio.session import ensure_checkpoint_dir, ship_code

CHECKPOINT_ROUNDS = 20
#: Up to so many partitions the driver adds up the histograms itself, without a stage in between.
DIRECT_PARTS = 16
#: Features share a code as long as it has at most so many values.
MOST_CODES = 1024
#: Accuracy of the sketch that the cuts come from (rank error one in so many rows).
SKETCH_ACCURACY = 10_000


@dataclass
class BoosterParams:
    growth: str = "level"
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    num_leaves: int = 31
    l2: float = 1.0
    gamma: float = 0.0
    min_hessian: float = 1.0
    min_rows: int = 1
    max_bins: int = 255
    #: Start from the weighted log-odds of the labels, or from zero.
    from_average: bool = False
    #: How splits count in ``featureImportances``: their mean gain, or their number.
    importance: str = "gain"


@dataclass
class Tree:
    """Nodes by number; ``feature`` -1 is a leaf. A row goes left if its bin is at most ``bin``."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)

    def add(self, sums) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.sums, sums)):
            column.append(v)
        return len(self.feature) - 1


@dataclass
class Packing:
    """Features that share a code: each group's features, and each feature's group, bins and place value in the code."""
    groups: list[list[int]]
    group: list[int]
    size: list[int]
    stride: list[int]
    codes: list[int]

    @classmethod
    def of(cls, sizes: list[int]) -> Packing:
        """Largest features first, each into the first group that has room for it."""
        groups, codes = [], []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            for k, c in enumerate(codes):
                if c * sizes[f] <= MOST_CODES:
                    groups[k].append(f)
                    codes[k] *= sizes[f]
                    break
            else:
                groups.append([f])
                codes.append(sizes[f])
        group, stride = [0] * len(sizes), [1] * len(sizes)
        for k, members in enumerate(groups):
            place = 1
            for f in reversed(members):
                group[f], stride[f] = k, place
                place *= sizes[f]
        return cls(groups, group, list(sizes), stride, codes)

    def pack(self, bins: np.ndarray) -> np.ndarray:
        """Codes (groups x rows) of binned features (rows x features)."""
        out = np.zeros((len(self.groups), len(bins)), np.uint16 if max(self.codes, default=0) <= 1 << 16 else np.uint32)
        for f in range(len(self.size)):
            out[self.group[f]] += (bins[:, f].astype(np.int64) * self.stride[f]).astype(out.dtype)
        return out

    def unpack(self, sums: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
        """Sums by (node, bin of each feature) from those by (node, code of each group)."""
        out = np.empty((len(sums[0]), int(offsets[-1])))
        for members, by_code in zip(self.groups, sums):
            # The first feature has the highest place value; what is left after it serves the others.
            rest = by_code
            for f in members:
                cube = rest.reshape(len(rest), self.size[f], -1)
                out[:, offsets[f]:offsets[f + 1]] = cube.sum(2)
                rest = cube.sum(1)
        return out

    def node_of(self, tree: Tree, codes: np.ndarray) -> np.ndarray:
        """The deepest node of every row of packed features."""
        at = np.zeros(codes.shape[1], np.intp)
        split = [n for n, f in enumerate(tree.feature) if f >= 0]
        if not split or not len(at):
            return at
        # Which side each code of a split's group goes to; a leaf leads to itself.
        width = max(self.codes)
        right = np.zeros((len(tree.feature), width), bool)
        group, child = np.zeros(len(tree.feature), np.intp), np.repeat(np.arange(len(tree.feature)), 2).reshape(-1, 2)
        depth = np.zeros(len(tree.feature), int)
        for n in split:
            f = tree.feature[n]
            group[n], child[n] = self.group[f], (tree.left[n], tree.right[n])
            right[n] = np.arange(width) // self.stride[f] % self.size[f] > tree.bin[n]
            depth[child[n]] = depth[n] + 1
        group *= codes.shape[1]
        flat, right, child, rows = codes.ravel(), right.ravel(), child.ravel(), np.arange(codes.shape[1])
        for _ in range(depth.max()):
            code = flat.take(group.take(at) + rows)
            at = child.take(2 * at + right.take(at * width + code))
        return at


def split_gain(gl, hl, g, h, p: BoosterParams):
    """Gain of parts (gl, hl) of nodes (g, h)."""
    gr, hr = g - gl, h - hl
    return 0.5 * (gl * gl / (hl + p.l2) + gr * gr / (hr + p.l2) - g * g / (h + p.l2)) - p.gamma


def best_splits(hist: np.ndarray, offsets: np.ndarray, p: BoosterParams) -> list[tuple | None]:
    """Per node of ``hist`` (nodes, all features' bins, [g, h, rows]): (gain, feature, bin, left sums), or None.

    A feature's last bin is no cut. Ties go to the first feature and bin.
    """
    sizes = np.diff(offsets)
    if not len(hist) or not len(sizes) or sizes.max() < 2:
        return [None] * len(hist)
    # The cuts of all features side by side; features of as many bins are added up together.
    first = np.concatenate([[0], np.cumsum(sizes - 1)])
    left = np.empty((len(hist), first[-1], 3))
    for size in np.unique(sizes[sizes > 1]):
        own = np.flatnonzero(sizes == size)
        sums = np.cumsum(hist[:, offsets[own, None] + np.arange(size)], axis=2)
        left[:, first[own, None] + np.arange(size - 1)] = sums[:, :, :-1]
    total = np.cumsum(hist[:, offsets[0]:offsets[1]], axis=1)[:, -1]
    gl, hl, nl = np.moveaxis(left, 2, 0)
    g, h, n = (total[:, k, None] for k in range(3))
    legal = (hl >= p.min_hessian) & (h - hl >= p.min_hessian) & (nl >= p.min_rows) & (n - nl >= p.min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(legal, split_gain(gl, hl, g, h, p), -np.inf)
    at = (gain >= gain.max(1, keepdims=True) - 1e-12).argmax(1)
    feature = np.searchsorted(first, at, "right") - 1
    return [(float(gain[i, c]), int(f), int(c - first[f]), tuple(map(float, left[i, c]))) if gain[i, c] > 1e-12 else None
            for i, (f, c) in enumerate(zip(feature, at))]


def prune_to_best(tree: Tree, num_leaves: int) -> Tree:
    """The tree that best-first growth makes of a fully expanded one."""
    out = Tree()
    out.add(tree.sums[0])
    queue = [(-tree.gain[0], 0, 0)] if tree.feature[0] >= 0 else []
    leaves = 1
    while queue and leaves < num_leaves:
        _, n, at = heapq.heappop(queue)
        out.feature[at], out.bin[at], out.gain[at] = tree.feature[n], tree.bin[n], tree.gain[n]
        for side, child in ((out.left, tree.left[n]), (out.right, tree.right[n])):
            side[at] = new = out.add(tree.sums[child])
            if tree.feature[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], child, new))
        leaves += 1
    return out


def leaf_values(tree: Tree, p: BoosterParams) -> np.ndarray:
    g, h, _ = np.array(tree.sums).reshape(-1, 3).T
    return np.where(np.array(tree.feature) < 0, -g / (h + p.l2) * p.learning_rate, 0.0)


@dataclass
class Block:
    """Rows of one partition: packed bins (groups x rows); labels and weights as (place, distinct values)."""
    codes: np.ndarray
    label_at: np.ndarray
    labels: np.ndarray
    weights: list[tuple[np.ndarray, np.ndarray]]


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct ones, which are few in labels and weights."""
    distinct, at = np.unique(values, return_inverse=True)
    return at.astype(np.uint8 if len(distinct) <= 1 << 8 else np.uint32), distinct


def _counts_matter(p: BoosterParams) -> bool:
    """Whether a split's rows must be counted: a side of enough second derivatives has a row."""
    return p.min_rows > 1 or p.min_hessian <= 0


def _histogram(block: Block, margins: list[np.ndarray], trees: list[Tree | None], frontiers: list[list[int]], offsets: np.ndarray,
               packing: Packing, counted: list[bool]) -> list[np.ndarray]:
    """For each booster: sums of g, h and, if they matter, rows by ([g, h, rows], frontier node, bin of each feature)."""
    out = []
    for margin, (weight_at, weights), tree, frontier, count in zip(margins, block.weights, trees, frontiers, counted):
        hist = np.zeros((3 if count else 2, len(frontier), int(offsets[-1])))
        if frontier and len(margin):
            number = np.full(len(tree.feature), -1, np.intp)
            number[frontier] = np.arange(len(frontier))
            at = number.take(packing.node_of(tree, block.codes))
            rows = np.flatnonzero(at >= 0)
            most = float(np.abs(weights).take(weight_at).sum())
            label_at, codes = block.label_at, block.codes
            if len(rows) < len(at):
                at, margin, weight_at, label_at = (v.take(rows) for v in (at, margin, weight_at, label_at))
                codes = codes.take(rows, axis=1)
            weight, label = weights.take(weight_at), block.labels.take(label_at)
            chance = 1.0 / (1.0 + np.exp(-margin))
            # g and h are at most the weight: no sum of these whole numbers is beyond what a double holds exactly.
            unit = 2.0 ** (math.frexp(max(most, 1e-300))[1] - 52)
            g, h = (np.rint(v / unit) for v in (weight * (chance - label), weight * chance * (1 - chance)))
            sums = [[] for _ in hist]
            for code, size in zip(codes, packing.codes):
                place = at * size + code
                for k, v in enumerate((g, h, None)[:len(hist)]):
                    sums[k].append(np.bincount(place, v, len(frontier) * size).reshape(len(frontier), size))
            for k, one in enumerate(sums):
                hist[k] = packing.unpack(one, offsets)
            hist[:2] *= unit
        out.append(hist)
    return out


def bin_edges(vectors: DataFrame, n_features: int, max_bins: int) -> list[list[float]]:
    """Ascending cuts of each feature: quantiles of a mergeable sketch, one pass for all features."""
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    row = vectors.agg(*[F.struct(F.min(F.col("x")[i]).alias("lo"), F.max(F.col("x")[i]).alias("hi"),
                                 F.approx_percentile(F.col("x")[i], shares, F.lit(SKETCH_ACCURACY)).alias("q")).alias(f"f{i}")
                        for i in range(n_features)]).first()
    # The largest value is no cut: nothing lies beyond it.
    return [sorted({row[i]["lo"], *(row[i]["q"] or [])} - {row[i]["hi"], None}) if row[i]["lo"] is not None else []
            for i in range(n_features)]


def fit(df: DataFrame, boosters: dict[str, tuple[BoosterParams, str]], features_col: str = "scaled", label: str = "Churn") -> dict[str, BoostedTreesModel]:
    """Boosters by name, each with its parameters and its weight column; all learn from the rows of ``df`` together."""
    ensure_checkpoint_dir(ship_code(df.sparkSession))
    names = list(boosters)
    params = [boosters[n][0] for n in names]
    rows = df.select(vector_to_array(features_col).alias("x"), F.col(label).cast("double").alias("y"),
                     *[F.col(boosters[n][1]).cast("double").alias(f"w{i}") for i, n in enumerate(names)]).filter("y is not null")
    first = rows.select(F.size("x").alias("p")).limit(1).collect()
    if not first:
        raise ValueError("no rows to learn from")
    n_features = first[0]["p"]
    edges = bin_edges(rows, n_features, max(p.max_bins for p in params))
    offsets = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)
    arrays = [np.array(e) for e in edges]
    packing = Packing.of(np.diff(offsets).tolist())

    def binned(batches):
        parts = [b for b in batches if b.num_rows]
        column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) if parts else np.zeros(0)
        x = np.concatenate([np.asarray(b.column("x").flatten()).reshape(-1, n_features) for b in parts]) if parts else np.zeros((0, n_features))
        kind = np.uint8 if max(map(len, arrays), default=0) < 256 else np.uint16
        bins = np.array([np.searchsorted(e, np.ascontiguousarray(x[:, f]), "left") for f, e in enumerate(arrays)]).astype(kind).T
        block = Block(packing.pack(bins if len(x) else np.zeros((0, n_features), kind)), *_coded(column("y")), [_coded(column(f"w{i}")) for i in range(len(names))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    blocks = rows.mapInArrow(binned, "block binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)
    totals = blocks.map(lambda b: [(float(w.take(at) @ b.labels.take(b.label_at)), float(w.take(at).sum())) for at, w in b.weights]).collect()
    starts = []
    for i, p in enumerate(params):
        pos, all_w = (sum(t[i][k] for t in totals) for k in (0, 1))
        starts.append(math.log(pos / (all_w - pos)) if p.from_average and 0 < pos < all_w else 0.0)
    # A block goes along with its scores: a zip of two tables would send both through workers of their own.
    state = blocks.map(lambda b: (b, [np.full(len(b.label_at), s) for s in starts])).persist(StorageLevel.MEMORY_AND_DISK)
    ensembles: list[list[Tree]] = [[] for _ in names]
    held = [blocks, state]
    for turn in range(max(p.rounds for p in params)):
        alive = [turn < p.rounds for p in params]
        trees = _grow(state, offsets, params, alive, packing)
        for ensemble, tree, on in zip(ensembles, trees, alive):
            if on:
                ensemble.append(tree)
        steps = [(tree, leaf_values(tree, p)) if on else None for tree, p, on in zip(trees, params, alive)]

        def moved(pair, steps=steps):
            block, old = pair
            return block, [m if s is None else m + s[1][packing.node_of(s[0], block.codes)] for m, s in zip(old, steps)]
        state = state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if (turn + 1) % CHECKPOINT_ROUNDS == 0:
            state.checkpoint()
            state.count()
        # The next round's first job fills the new scores from the old ones, which then go.
        while len(held) > 2:
            held.pop(0).unpersist()
    for r in held:
        r.unpersist()
    return {n: BoostedTreesModel.of(p, s, e, edges, n_features) for n, p, s, e in zip(names, params, starts, ensembles)}


def _grow(pairs, offsets, params, alive, packing) -> list[Tree]:
    """One tree for each booster, level by level; all boosters' histograms come from one job a level."""
    trees = [Tree() for _ in params]
    frontiers = [[t.add((0.0, 0.0, 0.0))] if on else [] for t, on in zip(trees, alive)]
    counted = [_counts_matter(p) for p in params]
    for depth in range(max(p.max_depth for p in params)):
        frontiers = [f if depth < p.max_depth else [] for f, p in zip(frontiers, params)]
        if not any(frontiers):
            break
        ends = [list(f) for f in frontiers]
        hists = pairs.map(lambda pair: _histogram(pair[0], pair[1], trees, ends, offsets, packing, counted)).treeReduce(
            lambda a, b: [x + y for x, y in zip(a, b)], depth=1 if pairs.getNumPartitions() <= DIRECT_PARTS else 2)
        for i, (tree, p, hist) in enumerate(zip(trees, params, hists)):
            if not counted[i]:
                hist, p = np.concatenate([hist, np.zeros_like(hist[:1])]), replace(p, min_rows=0)
            hist = np.moveaxis(hist, 0, 2)
            if depth == 0 and frontiers[i]:
                tree.sums[0] = tuple(map(float, hist[0, offsets[0]:offsets[1]].sum(0)))
            new = []
            for n, best in zip(frontiers[i], best_splits(hist, offsets, p)):
                if best is None:
                    continue
                tree.gain[n], tree.feature[n], tree.bin[n], left = best
                tree.left[n] = tree.add(left)
                tree.right[n] = tree.add(tuple(a - b for a, b in zip(tree.sums[n], left)))
                new += [tree.left[n], tree.right[n]]
            frontiers[i] = new
    return [prune_to_best(t, p.num_leaves) if p.growth == "leaf" and on else t for t, p, on in zip(trees, params, alive)]


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster: adds ``rawPrediction`` and ``probability`` vectors; its trees are kept as one text parameter."""

    trees = Param(Params._dummy(), "trees", "nodes of all trees as JSON", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None, featuresCol=None):
        super().__init__()
        self._setDefault(featuresCol="scaled")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._table = None

    @classmethod
    def of(cls, params: BoosterParams, start: float, ensemble: list[Tree], edges: list[list[float]], n_features: int) -> BoostedTreesModel:
        nodes, roots, gains, counts = [], [], np.zeros(n_features), np.zeros(n_features)
        for tree in ensemble:
            base = len(nodes)
            roots.append(base)
            values = leaf_values(tree, params)
            for n, f in enumerate(tree.feature):
                threshold = edges[f][tree.bin[n]] if f >= 0 else 0.0
                nodes.append((f, threshold, base + tree.left[n], base + tree.right[n], tree.sums[n][1], float(values[n])))
                if f >= 0:
                    gains[f] += tree.gain[n]
                    counts[f] += 1
        weight = counts if params.importance == "split" else gains / np.maximum(counts, 1)
        payload = {"params": asdict(params), "base": start, "roots": roots, "nodes": nodes,
                   "importances": (weight / max(weight.sum(), 1e-300)).tolist()}
        return cls(trees=json.dumps(payload))

    def _payload(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def node_table(self) -> NodeTable:
        """All trees; a leaf adds to the log-odds, a node's cover is its sum of second derivatives."""
        if getattr(self, "_table", None) is None:
            p = self._payload()
            feature, threshold, left, right, cover, value = (list(c) for c in zip(*p["nodes"]))
            self._table = NodeTable(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(cover), np.array(value),
                                    np.array(p["roots"]), p["base"])
        return self._table

    @property
    def params_used(self) -> BoosterParams:
        return BoosterParams(**self._payload()["params"])

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self._payload()["importances"])

    def _transform(self, df: DataFrame) -> DataFrame:
        table = self.node_table()
        ship_code(df.sparkSession)

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(table.predict(np.array(x.tolist(), float)) if len(x) else [], dtype=float)

        z = F.col("_margin")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        out = df.withColumn("_margin", margin(vector_to_array(self.getOrDefault(self.featuresCol))))
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-z, z)), "probability": array_to_vector(F.array(1 - p, p)),
                                "prediction": (p > 0.5).cast("double")}).drop("_margin")
