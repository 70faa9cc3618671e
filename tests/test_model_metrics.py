"""Curves of several models from one sort, against the single-model operators; one-pass K-Means against plain Lloyd."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.operators import cluster as CL
from retentio.operators import metrics as M
from retentio.operators import model_metrics as MM


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        y = None if i % 50 == 0 else int(rng.integers(0, 2))
        # A model that ties on a third of the rows, one with unknown scores, one constant.
        rows.append((i, y, 0.4 if i % 3 == 0 else round(float(rng.random()), 2), None if i % 4 == 0 else float(rng.random()), 0.5))
    return spark.createDataFrame(rows, "id long, y int, tied double, partial double, constant double").repartition(5).cache()


NAMES = ["tied", "partial", "constant"]


def rows(df, *drop):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


def test_each_model_equals_its_own_curve(wide):
    scored = MM.long_scores(wide, {n: F.col(n) for n in NAMES}, "y", ("id",))
    assert scored.columns == ["id", "label", "model", "score"]
    cum = MM.cumulated(scored)
    for name in NAMES:
        own = wide.select(F.col("y").alias("label"), F.col(name).alias("score"))
        mine = lambda df: rows(df.filter(F.col("model") == name), "model")  # noqa: B023, E731
        assert mine(MM.roc_curves(cum)) == rows(M.roc_curve(own))
        assert mine(MM.pr_curves(cum)) == rows(M.pr_curve(own))
        one = MM.summaries(cum).filter(F.col("model") == name).first()
        assert one["auc"] == M.auc_roc(own).first()["auc"]
        assert one["avg_precision"] == pytest.approx(M.avg_precision(own).first()["avg_precision"], abs=1e-10)
        known = own.filter("score is not null")
        report = M.classification_report(known).first()
        assert all(one[k] == report[k] for k in ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1"))
        assert mine(MM.confusion_matrices(scored.filter("score is not null"))) == rows(M.confusion_matrix(known))
        assert mine(MM.threshold_sweeps(scored.filter("score is not null"))) == rows(M.threshold_sweep(known))


def test_vote_and_one_scoring(wide):
    seen = []

    def scorer(name):
        def add(df, out):
            seen.append(name)
            return df.withColumn(out, F.col(name))
        return add
    got = MM.score_all(wide, {n: scorer(n) for n in NAMES}, ("Vote", ["tied", "constant", "absent"]), "y", ("id",))
    assert seen == NAMES and got.select("model").distinct().count() == 4
    off = got.filter("model = 'Vote'").join(wide, "id").filter(F.abs(F.col("score") - (F.col("tied") + F.col("constant")) / 2) > 1e-15)
    assert off.count() == 0
    assert MM.score_all(wide, {"tied": scorer("tied")}, ("Vote", ["tied"]), "y", ("id",)).select("model").distinct().count() == 1
    assert MM.comparison(MM.cumulated(got.limit(0))).count() == 0


def plain_lloyd(x, centres):
    for _ in range(300):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        done = ((new - centres) ** 2).sum(1).max() <= 1e-8
        centres = new
        if done:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.6, (150, 2)) for m in ((0, 0), (4, 0), (0, 5), (6, 6))])
    df = spark.createDataFrame([(f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "customerID string, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="xs").transform(df).repartition(4).cache(), x


def test_all_models_in_one_scan_equal_separate_fits(points):
    vec, x = points
    starts = {(k, i): CL.plus_plus(x, k, np.random.default_rng([i, k])) for k in (2, 3, 5) for i in range(3)}
    starts["far"] = np.array([[0.0, 0.0], [1e6, 1e6]])
    got = CL.lloyd_grid(vec.select(vector_to_array("xs").alias("x")), starts)
    for key, begin in starts.items():
        centres, cost = plain_lloyd(x, begin)
        assert np.allclose(got[key][0], centres, atol=1e-9) and got[key][1] == pytest.approx(cost, rel=1e-9)
    assert CL.lloyd_grid(vec.select(vector_to_array("xs").alias("x")), {}) == {}


def test_grid_keeps_the_best_and_gives_spark_models(spark, points, tmp_path):
    vec, x = points
    models = CL.kmeans_grid(vec, [2, 4], n_init=4)
    assert models[4].inertia_ < models[2].inertia_ and len(models[4].clusterCenters()) == 4
    assert models[4].inertia_ == pytest.approx(CL.inertia(models[4], vec), rel=1e-9)
    assert CL.assign_clusters(models[4], vec).groupBy("Cluster").count().agg(F.min("count")).first()[0] > 100
    models[4].write().save(f"{tmp_path}/m")
    again = type(models[4]).load(f"{tmp_path}/m")
    assert np.allclose(again.clusterCenters(), models[4].clusterCenters())
    table = {r["k"]: r for r in CL.elbow_table(spark, vec, models).collect()}
    assert table[4]["inertia"] == models[4].inertia_ and table[4]["silhouette"] > 0.7
    with pytest.raises(ValueError, match="no rows"):
        CL.kmeans_grid(vec.limit(0), [2])
