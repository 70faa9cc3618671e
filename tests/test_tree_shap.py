"""Exact tree attributions against all-subset Shapley values and against fitted models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.operators import tree_shap as TS


def random_table(seed, trees, depth, features):
    """Trees that split on the same feature again along a path."""
    rng = np.random.default_rng(seed)
    rows, roots = [], []

    def grow(level, cover):
        at = len(rows)
        rows.append(None)
        if level == depth or (level and rng.random() < 0.25):
            rows[at] = (-1, 0.0, 0, 0, cover, rng.normal())
            return at
        share = rng.uniform(0.1, 0.9)
        f, thr = int(rng.integers(features)), rng.normal()
        left = grow(level + 1, cover * share)
        right = grow(level + 1, cover * (1 - share))
        rows[at] = (f, thr, left, right, cover, 0.0)
        return at
    for _ in range(trees):
        roots.append(grow(0, 100.0))
    cols = list(zip(*rows))
    return TS.NodeTable(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), np.array(cols[5]),
                        np.array(roots))


def known_value(table, x, known):
    """The output when only the features in ``known`` are known."""
    def at(n):
        f = table.feature[n]
        if f < 0:
            return table.value[n]
        left, right = table.left[n], table.right[n]
        if f in known:
            return at(left) if x[f] <= table.threshold[n] else at(right)
        return (table.cover[left] * at(left) + table.cover[right] * at(right)) / table.cover[n]
    return sum(at(r) for r in table.roots) + table.base


def brute(table, x):
    p = len(x)
    out = np.zeros(p)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for k in range(p):
            w = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
            for s in itertools.combinations(rest, k):
                out[i] += w * (known_value(table, x, {*s, i}) - known_value(table, x, set(s)))
    return out


@pytest.mark.parametrize("seed,depth", [(1, 2), (2, 3), (3, 5), (4, 7), (5, 1), (6, 0)])
def test_equals_all_subsets(seed, depth):
    table = random_table(seed, 3, depth, 6)
    x = np.random.default_rng(seed + 100).normal(size=(7, 6))
    got = TS.shapley_values(table, x)
    assert np.allclose(got, [brute(table, r) for r in x], atol=1e-10)
    assert np.allclose(got.sum(1), table.predict(x) - table.expectation(), atol=1e-10)


def test_feature_never_split_on_gets_nothing():
    table = random_table(9, 4, 4, 3)
    got = TS.shapley_values(table, np.random.default_rng(0).normal(size=(5, 8)))
    assert got.shape == (5, 8) and (got[:, 3:] == 0).all()


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=400) > 0).astype(int)
    rows = [(f"c{i}", *map(float, r), int(t), 1.0 + float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double, y int, w double").repartition(3)
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="scaled").transform(df).cache()
    common = dict(featuresCol="scaled", labelCol="y", weightCol="w", seed=1)
    return df, [DecisionTreeClassifier(maxDepth=4, **common).fit(df), RandomForestClassifier(numTrees=7, maxDepth=5, **common).fit(df),
                GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, **common).fit(df)]


@pytest.mark.parametrize("which", [0, 1, 2])
def test_fitted_models(fitted, which):
    df, models = fitted
    model, table = models[which], TS.node_table(models[which])
    pred = model.transform(df).select("customerID", vector_to_array("probability")[1].alias("p"), vector_to_array("scaled").alias("x"))
    rows = pred.toPandas()
    x = np.array(rows["x"].tolist())
    out = table.predict(x)
    assert np.allclose(1 / (1 + np.exp(-out)) if which == 2 else out, rows["p"], atol=1e-9)
    attr = TS.attribute(pred, table, list("abcd"), "x", "x").select("customerID", F.inline("attr"))
    sums = attr.groupBy("customerID").agg(F.sum("shap").alias("s"), F.count("*").alias("n")).toPandas().set_index("customerID")
    assert (sums["n"] == 4).all() and len(sums) == 400
    assert np.allclose(sums.loc[rows["customerID"], "s"], out - table.expectation(), atol=1e-9)
    one = TS.attribute(pred.filter("customerID = 'c7'"), table, list("abcd"), "x", "x").select(F.inline("attr")).collect()
    assert np.allclose([r["shap"] for r in one], brute(table, x[rows.index[rows["customerID"] == "c7"][0]]), atol=1e-9)
    assert TS.attribute(pred.limit(0), table, list("abcd"), "x", "x").count() == 0


def test_leaf_cases_against_sums_over_all_subsets():
    """What a leaf adds, by the features passed, for shares down to 1e-12; a feature that splits twice keeps one bit."""
    from itertools import combinations
    from math import factorial
    z = np.array([0.3, 1e-12, 0.9])
    points = max(1, -(-len(z) // 2))
    t, weight = np.polynomial.legendre.leggauss(points)
    found = TS._leaf_shares(z, (t + 1) / 2, weight / 2)
    for case in range(8):
        o = np.array([case >> j & 1 for j in range(3)], float)
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            total = sum(factorial(k) * factorial(2 - k) / factorial(3) * np.prod([o[j] if j in known else z[j] for j in rest])
                        for k in range(3) for known in combinations(rest, k))
            assert np.isclose(found[i, case], (o[i] - z[i]) * total, rtol=1e-9, atol=1e-12)


def test_rows_of_many_small_batches_are_attributed_together(spark, monkeypatch):
    table = TS.NodeTable(*(np.array(v) for v in ([0, -1, -1], [0.5, 0, 0], [1, 0, 0], [2, 0, 0], [4.0, 1, 3], [0.0, 1, 2])), np.array([0]))
    monkeypatch.setattr(TS, "BLOCK_ROWS", 64)
    monkeypatch.setattr(TS, "LEAST_ROWS", 1000)
    rows = spark.range(200).selectExpr("cast(id as string) customerID", "array(double(id % 2)) x")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = TS.attribute(rows, table, ["f"], "x", "x").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {v: TS.shapley_values(table, np.array([[v]]))[0, 0] for v in (0.0, 1.0)}
    assert len(out) == 200
    for r in out:
        assert r["attr"][0]["value"] == int(r["customerID"]) % 2
        assert np.isclose(r["attr"][0]["shap"], want[r["attr"][0]["value"]])


@pytest.mark.parametrize("seed,depth", [(1, 3), (2, 5), (5, 1), (6, 0)])
def test_leaves_of_small_subtrees_are_looked_up_together(seed, depth, monkeypatch):
    table = random_table(seed, 3, depth, 4)  # features come again on a path
    x = np.random.default_rng(seed).normal(size=(4000, 4))
    looked, shares = [], TS._leaf_shares
    monkeypatch.setattr(TS, "_leaf_shares", lambda z, t, w: looked.append(len(z)) or shares(z, t, w))
    together = TS.shapley_values(table, x)
    once = len(looked)
    monkeypatch.setattr(TS, "MERGED_SPLITS", 0)
    apart = TS.shapley_values(table, x)
    assert np.allclose(together, apart, atol=1e-12) and len(looked) == 2 * once
    assert np.allclose(together[:3], [brute(table, r) for r in x[:3]], atol=1e-10)


def test_rows_are_dealt_to_whole_rounds_of_the_cores(spark, monkeypatch):
    table = TS.NodeTable(*(np.array(v) for v in ([0, -1, -1], [0.5, 0, 0], [1, 0, 0], [2, 0, 0], [4.0, 1, 3], [0.0, 1, 2])), np.array([0]))
    monkeypatch.setattr(TS, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(TS, "LEAST_ROWS", 10)
    rows = spark.range(450).selectExpr("cast(id as string) customerID", "array(double(id % 2)) x")
    cores = spark.sparkContext.defaultParallelism
    found = TS.attribute(rows, table, ["f"], "x", "x").select(F.spark_partition_id().alias("p")).distinct().count()
    assert found == min(cores * -(-450 // (50 * cores)), 45)


def test_stored_forest_is_read_once_and_votes_as_spark_does(fitted, monkeypatch):
    df, models = fitted
    table = TS.node_table(models[1])
    monkeypatch.setattr(TS, "_stored_nodes", lambda c: pytest.fail("read again"))
    assert TS.node_table(models[1]) is table and TS.node_table(models[1]).shares.shape[0] == 2
    rows = models[1].transform(df).select(vector_to_array("probability")[1].alias("p"), vector_to_array("scaled").alias("x")).toPandas()
    assert (table.vote(np.array(rows["x"].tolist())) == rows["p"]).all()
