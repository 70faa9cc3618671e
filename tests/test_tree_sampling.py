"""Sampled Shapley values of trees: the walk over intervals of steps against scoring every step."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retentio.operators import explain as EX
from retentio.operators import tree_sampling as SA
from tests.test_tree_shap import random_table


@pytest.mark.parametrize("m", [8, 3])
def test_walk_equals_scoring_every_step(m):
    table = random_table(4, 5, 6, 7)
    chance = np.random.default_rng(m)
    x, background = chance.normal(size=(50, 7)), chance.normal(size=7)
    hashes = chance.integers(0, 5, (50, m, 7))  # equal hashes keep the features' order
    on = SA.orders_of(hashes)
    want = np.zeros((50, 7))
    for r in range(50):
        for k in range(m):
            order = sorted(range(7), key=lambda f: (hashes[r, k, f], f))
            assert [on[r, k, f] for f in order] == list(range(1, 8))
            at = background.copy()
            before = table.predict(at[None])[0]
            for f in order:
                at[f] = x[r, f]
                after = table.predict(at[None])[0]
                want[r, f] += (after - before) / m
                before = after
    assert np.allclose(SA.sampled_values(table, x, on, background), want, atol=1e-12)


@pytest.fixture(scope="module")
def fitted(spark):
    chance = np.random.default_rng(0)
    x = chance.normal(size=(300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + chance.normal(scale=0.3, size=300) > 0).astype(int)
    # Some ids come twice or three times, some are null.
    ids = [None if i % 50 == 0 else f"c{i - i % 7 if i < 60 else i}" for i in range(300)]
    rows = [(c, *map(float, r), int(t)) for c, r, t in zip(ids, x, y)]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double, y int").repartition(3)
    assembled = [VectorAssembler(inputCols=list("abcd"), outputCol=c) for c in ("scaled", "features")]
    train = assembled[0].transform(df).cache()
    common = dict(featuresCol="scaled", labelCol="y", seed=1)
    return df, [PipelineModel([*assembled, c.fit(train)]) for c in (DecisionTreeClassifier(maxDepth=4, **common),
                                                                   RandomForestClassifier(numTrees=7, maxDepth=5, **common))]


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("repeats", [True, False])
def test_trees_are_walked_and_give_what_the_scored_steps_give(fitted, monkeypatch, which, repeats):
    df, models = fitted
    model = models[which]
    df = df if repeats else df.dropna().dropDuplicates(["customerID"])
    key = lambda r: (r["customerID"], r["feature"])
    with monkeypatch.context() as patch:
        # No row is scored for a step.
        patch.setattr(type(model.stages[-1]), "transform", lambda *a: pytest.fail("rows were scored"))
        got = {key(r): (r["value"], r["shap"]) for r in EX.shap_sampled(model, df, list("abcd"), m=3).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(EX, "RandomForestClassificationModel", int)
        patch.setattr(EX, "DecisionTreeClassificationModel", int)
        rows = EX.shap_sampled(model, df, list("abcd"), m=3).collect()
    assert len(rows) == len(got) == 4 * df.select("customerID").distinct().count()
    for r in rows:
        assert got[key(r)][0] == r["value"] and np.isclose(got[key(r)][1], r["shap"], atol=1e-12)


def test_no_rows(fitted):
    df, models = fitted
    assert EX.shap_sampled(models[1], df.filter(F.lit(False)), list("abcd")).count() == 0
