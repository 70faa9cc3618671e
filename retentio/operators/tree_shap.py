"""Exact path-dependent Shapley attributions of trees and tree ensembles.

The value of a set of known features is the tree's expectation when splits on unknown features
are followed on both sides in proportion to the training weight (the cover) of the children.
For a leaf with value v whose path splits on m different features, let z_j be the product of the
cover shares of the path's splits on feature j, and o_j = 1 if the row passes all of them, else 0.
The Shapley value of feature i is then the sum over leaves of

    v (o_i - z_i) sum_{S without i} |S|! (m-|S|-1)! / m!  prod_{S} o_j  prod_{not S} z_j

and, as k! (m-1-k)! / m! is the integral of t^k (1-t)^(m-1-k) over [0, 1], of

    v (o_i - z_i)  integral of  prod_{j != i} ((1-t) z_j + t o_j) dt.

The integrand is a polynomial of degree m - 1, which Gauss-Legendre points integrate exactly. What a
leaf adds so depends on z, the same for all rows, and on which of the m features a row passes:
at most 2^m cases, worked out once for a block of rows, whose cases one walk down the tree finds.
The attributions of a row sum to its prediction minus the expectation.

A fitted model becomes a flat table of nodes. It is as large as the model (trees x nodes, bounded
by the model's settings) and goes to every task; rows stay where they are, and each is attributed
by itself. Classifiers of one tree or a forest are attributed as class-1 probability, boosted
trees as log-odds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from retentio.session import ensure_checkpoint_dir, ship_code
from retentio.sources.io import delete_table

#: Rows of one task; attributing a row visits every node of the model. Fewer, down to the least, keep all cores at work.
ROWS_PER_TASK, LEAST_ROWS = 32_768, 1000
#: A table has at most so many tasks, then they take more rows each.
MOST_TASKS = 100_000
#: Rows that are walked through a tree together.
BLOCK_ROWS = 32_768
#: Subtrees of at most so many splits are looked up whole, if their splits and the path's features are at most so many together.
MERGED_SPLITS, MERGED_BITS = 4, 12


@dataclass
class NodeTable:
    """Nodes of all trees: ``feature`` -1 at leaves; x <= threshold goes left; ``value`` is what a leaf adds to the output."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float = 0.0
    #: Shares of the two classes at each node, of trees whose votes are added up.
    shares: np.ndarray | None = None

    def depth(self) -> int:
        deepest, level = 0, [int(r) for r in self.roots]
        while level:
            level = [int(c) for n in level if self.feature[n] >= 0 for c in (self.left[n], self.right[n])]
            deepest += bool(level)
        return deepest

    def expectation(self) -> float:
        """The model's output without any known feature."""
        total = self.base
        stack = [(int(r), 1.0) for r in self.roots]
        while stack:
            n, share = stack.pop()
            if self.feature[n] < 0:
                total += share * self.value[n]
            else:
                stack += [(int(c), share * self.cover[c] / self.cover[n]) for c in (self.left[n], self.right[n])]
        return float(total)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the leaf that every row of ``x`` ends in."""
        n, rows = len(x), np.arange(len(x))
        flat = np.ascontiguousarray(x.T).ravel()
        inner = self.feature >= 0
        column = np.where(inner, self.feature, 0) * n
        own = np.arange(len(self.feature))
        # A leaf leads to itself.
        child = np.stack([np.where(inner, self.right, own), np.where(inner, self.left, own)], axis=1).ravel()
        levels = self.depth()
        for r in self.roots:
            at = np.full(n, r, np.intp)
            for _ in range(levels if n and flat.size else 0):
                goes_left = flat.take(column.take(at) + rows) <= self.threshold.take(at)
                at = child.take(2 * at + goes_left)
            yield at

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Class-1 probability as Spark's forests add it up: both classes' shares tree by tree, then their quotient."""
        out = np.zeros((2, len(x)))
        for at in self.leaves(x):
            out += self.shares.take(at, axis=1)
        total = out.sum(0)
        return out[1] / np.where(total == 0, 1.0, total)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for at in self.leaves(x):
            out += self.value[at]
        return out


@lru_cache(None)
def _passed(m: int) -> np.ndarray:
    """(features, cases): whether case c passes feature j, its bit j."""
    return (np.arange(1 << m) >> np.arange(m)[:, None] & 1).astype(bool)


def _leaf_shares(z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a leaf of value 1 adds to each feature of its path (features x cases), by the features that a row passes."""
    m = len(z)
    failed = np.multiply.outer(z, 1 - t)
    factor = failed + t
    product = np.ones((1 << m, len(t)))
    for j in range(m):
        half = 1 << j
        np.multiply(product[:half], factor[j], out=product[half:2 * half])
        product[:half] *= failed[j]
    # The other features' product is that of all, without the feature's own factor.
    return np.where(_passed(m), (weight * (1 - z)[:, None] / factor) @ product.T, (weight * -z[:, None] / failed) @ product.T)


def shapley_values(table: NodeTable, x: np.ndarray) -> np.ndarray:
    """Attributions (rows x features) of the rows of ``x``.

    What a leaf adds depends only on which of its path's features a row passes: at most two to the
    power of the path's features cases, which are worked out once for all rows. The leaves of a small
    subtree are put together: for every outcome of its splits, what they add is looked up once.
    """
    phi = np.zeros(x.shape[::-1])
    points = max(1, -(-min(table.depth(), x.shape[1]) // 2))
    t, weight = np.polynomial.legendre.leggauss(points)
    t, weight = (t + 1) / 2, weight / 2
    columns = np.ascontiguousarray(x.T)
    feature, left, right = (c.tolist() for c in (table.feature, table.left, table.right))
    threshold, value, cover = (c.tolist() for c in (table.threshold, table.value, table.cover))
    splits: dict[int, list[int]] = {}

    def below(n: int) -> list[int]:
        """The splits of the subtree, in order."""
        if n not in splits:
            splits[n] = [] if feature[n] < 0 else [n, *below(left[n]), *below(right[n])]
        return splits[n]

    def walk(n: int, passed: np.ndarray, place: dict, z: list, goes_left, add, whole: bool) -> None:
        """``passed`` has bit j of each row set if the row passes all splits so far on the path's feature j."""
        f = feature[n]
        if f < 0:
            if value[n] and z:
                case = _leaf_shares(np.array(z), t, weight) * value[n]
                for g, j in place.items():
                    add(g, case[j].take(passed))
            return
        inner, bits = below(n), len(z) + len(below(n))
        if whole and len(inner) <= MERGED_SPLITS and bits <= MERGED_BITS and len(x) >> bits >= 4:
            # Few splits are left: what all their leaves add is worked out for every outcome, then looked up once for each row.
            bit = {s: len(z) + i for i, s in enumerate(inner)}
            code = passed
            for s, i in bit.items():
                code = code | goes_left(s).astype(np.intp) << i
            outcomes, sums = np.arange(1 << bits), {}

            def keep(g: int, v: np.ndarray) -> None:
                sums[g] = sums[g] + v if g in sums else v
            walk(n, outcomes & (1 << len(z)) - 1, place, z, lambda s: (outcomes >> bit[s] & 1).astype(bool), keep, False)
            for g, v in sums.items():
                add(g, v.take(code))
            return
        side = goes_left(n)
        new = f not in place
        j = place.setdefault(f, len(z))
        before = None if new else z[j]
        for child, goes in ((left[n], side), (right[n], ~side)):
            share = cover[child] / cover[n]
            if share == 0.0:
                # No training weight went here: known features alone lead to it.
                share = 1e-12
            if new:
                walk(child, passed | goes.astype(np.intp) << j, place, [*z, share], goes_left, add, whole)
            else:
                # A row that failed the feature above stays failed: only its share shrinks.
                walk(child, np.where(goes, passed, passed & ~(1 << j)), place, [*z[:j], before * share, *z[j + 1:]], goes_left, add, whole)
        if new:
            del place[f]

    def total(g: int, v: np.ndarray) -> None:
        phi[g] += v

    for r in table.roots:
        splits.clear()
        walk(int(r), np.zeros(len(x), np.intp), {}, [], lambda n: columns[feature[n]] <= threshold[n], total, True)
    return phi.T


def node_table(classifier) -> NodeTable:
    """Nodes of a fitted tree, forest or gradient-boosted classifier; Spark's own are read from their stored form, once."""
    if hasattr(classifier, "node_table"):
        return classifier.node_table()
    if getattr(classifier, "_retentio_nodes", None) is None:
        classifier._retentio_nodes = _stored_nodes(classifier)  # noqa: SLF001
    return classifier._retentio_nodes  # noqa: SLF001


def _stored_nodes(classifier) -> NodeTable:
    spark = SparkSession.active()
    folder = f"{ensure_checkpoint_dir(spark)}/retentio-nodes-{uuid.uuid4().hex}"
    classifier.write().save(folder)
    boosted = hasattr(classifier, "treeWeights") and type(classifier).__name__.startswith("GBT")
    try:
        stored = spark.read.parquet(f"{folder}/data")
        node = "nodeData." if "nodeData" in stored.columns else ""
        split, stats = f"{node}split", F.col(f"{node}impurityStats")
        # As large as the model itself, which the driver holds already. Classification nodes hold the weight of
        # each class, regression nodes weight, sum and sum of squares.
        nodes = stored.select(
            (F.col("treeID") if node else F.lit(0)).alias("tree"), *[F.col(f"{node}{c}").alias(c) for c in ("id", "prediction", "leftChild", "rightChild")],
            F.col(f"{split}.featureIndex").alias("feature"), F.col(f"{split}.numCategories").alias("categories"),
            F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
            F.size(stats).alias("classes"), F.aggregate(stats, F.lit(0.0), lambda a, b: a + b).alias("all"),
            F.get(stats, F.lit(0)).alias("first"), F.get(stats, F.lit(1)).alias("second")).toArrow().to_pandas()
    finally:
        delete_table(spark, folder)
    nodes = nodes.sort_values(["tree", "id"], kind="stable")
    tree, left, right = (nodes[c].to_numpy(np.int64) for c in ("tree", "leftChild", "rightChild"))
    weights = np.array(classifier.treeWeights if hasattr(classifier, "treeWeights") else [1.0], float)
    # A tree's nodes are numbered from 0 and lie together.
    roots = np.flatnonzero(np.diff(tree, prepend=-1)).astype(np.int64)
    base = roots[np.searchsorted(tree[roots], tree)]
    if not (nodes["id"].to_numpy(np.int64) == np.arange(len(nodes)) - base).all():
        raise ValueError("a tree's nodes are not numbered in a row")
    inner = left >= 0
    if (nodes["categories"].to_numpy()[inner] >= 0).any():
        raise ValueError("categorical splits are not used by these models")
    total, first, second = (nodes[c].to_numpy(float) for c in ("all", "first", "second"))
    cover = first if boosted else total
    if boosted:
        value, shares = 2.0 * weights[tree] * nodes["prediction"].to_numpy(float), None
    else:
        known = (nodes["classes"].to_numpy() > 1) & (total != 0)
        whole = np.where(known, total, 1.0)
        value = np.where(known, second / whole / len(weights), 0.0)
        shares = np.stack([np.where(known, v / whole, 0.0) for v in (first, second)]) if (nodes["classes"] == 2).all() else None
    return NodeTable(np.where(inner, nodes["feature"].to_numpy(np.int64), -1), np.where(inner, nodes["threshold"].to_numpy(float), 0.0),
                     np.where(inner, base + left, 0), np.where(inner, base + right, 0), cover, value, roots, shares=shares)


def attribute(vectors: DataFrame, table: NodeTable, features: list[str], input_col: str, value_col: str,
              id_col: str = "customerID") -> DataFrame:
    """One row per id with an array of (feature, value, shap); ``input_col`` holds the model's inputs as an array."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def attributed(batches):
        ids, values, x = (pa.concat_arrays([b.column(c) for b in batches]) for c in (id_col, "value", "x"))
        phi = shapley_values(table, np.asarray(x.flatten()).reshape(len(ids), -1))
        offsets = np.arange(len(ids) + 1, dtype=np.int32) * len(features)
        return pa.RecordBatch.from_arrays([ids, values, pa.ListArray.from_arrays(pa.array(offsets), pa.array(phi.ravel()))],
                                          names=[id_col, "value", "shap"])

    def run(batches):
        held, rows = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                held.append(whole.slice(at, BLOCK_ROWS))
                rows += held[-1].num_rows
                if rows >= BLOCK_ROWS:
                    yield attributed(held)
                    held, rows = [], 0
        if held:
            yield attributed(held)

    # A model visit costs far more than a row's bytes say, so tasks are cut by rows. Ids are dealt evenly whatever they are.
    ship_code(vectors.sparkSession)
    n = vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # Whole rounds of the cores; fewer tasks only where they would get too small.
    tasks = max(1, min(cores * -(-n // (max(ROWS_PER_TASK, n // MOST_TASKS) * cores)), n // LEAST_ROWS))
    slim = vectors.select(id_col, F.col(input_col).alias("x"), F.col(value_col).alias("value")).repartition(tasks)
    done = slim.mapInArrow(run, f"{id_col} {kind}, value array<double>, shap array<double>")
    names = F.array(*[F.lit(f) for f in features])
    return done.select(id_col, F.transform(F.arrays_zip(names.alias("feature"), "value", "shap"), lambda s: F.struct(
        s["feature"].alias("feature"), s["value"].alias("value"), s["shap"].alias("shap"))).alias("attr"))


def shap_tree_arrays(model: PipelineModel, df: DataFrame, features: list[str], id_col: str = "customerID") -> DataFrame:
    """X5 (trees): exact attributions of a fitted pipeline, one row per customer with an array of (feature, value, shap)."""
    cur = df
    for stage in model.stages[:-1]:
        cur = stage.transform(cur)
    arrays = cur.select(id_col, vector_to_array("scaled").alias("_xs"), vector_to_array("features").alias("_x"))
    return attribute(arrays, node_table(model.stages[-1]), features, "_xs", "_x", id_col)


def shap_tree(model: PipelineModel, df: DataFrame, features: list[str], id_col: str = "customerID") -> DataFrame:
    """X5 (trees): (id, feature, value, shap) for every customer and feature."""
    return shap_tree_arrays(model, df, features, id_col).select(id_col, F.inline("attr"))
