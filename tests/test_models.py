"""Model queries on the fixture: scores in [0, 1], AUC above chance, clustering shapes."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_models_train_score_and_compare(spark):
    from retentio.operators import models as MD
    from retentio.plans.registry import featured
    sp = MD.stratified_split(featured(spark, SF)).checkpoint(eager=True)
    small = {"XGBoost": {"n_estimators": 5}, "LightGBM": {"n_estimators": 5},
             "Random Forest": {"n_estimators": 20}}
    models, spec = MD.train_all(sp, params=small)
    cmp = MD.model_comparison(models, sp).toPandas()
    assert len(cmp) == 6 and set(cmp.model) >= {"Logistic Regression", "Voting Ensemble"}
    assert (cmp.auc_roc > 0.5).all()
    scored = MD.score(models["Random Forest"], featured(spark, SF))
    r = scored.agg(F.min("churn_prob").alias("lo"), F.max("churn_prob").alias("hi")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0
    imp = MD.feature_importance(models["Random Forest"], spark, spec.features).toPandas()
    assert abs(imp.importance.sum() - 1.0) < 1e-6


def test_split_is_stratified_and_exact(spark):
    from retentio.operators import models as MD
    from retentio.plans.registry import cleaned
    sp = MD.stratified_split(cleaned(spark, SF)).toPandas()
    for _, g in sp.groupby("Churn"):
        assert (g.split == "test").sum() == round(0.2 * len(g))


def test_linear_attributions_sum_to_logit_gap(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from retentio.operators import explain as EX
    from retentio.operators import models as MD
    from retentio.plans.registry import featured
    feats = featured(spark, SF)
    model = MD.train_model(feats, "Logistic Regression")
    spec = MD.feature_spec(feats)
    attr = EX.shap_linear(model, feats, spec.features).groupBy("customerID").agg(
        F.sum("shap").alias("s")).toPandas().set_index("customerID")
    raw = (model.transform(feats).select("customerID", vector_to_array("rawPrediction")[1].alias("z"))
           .toPandas().set_index("customerID"))
    intercept = model.stages[-1].intercept
    assert np.allclose(attr.s.sort_index(), (raw.z - intercept).sort_index(), atol=1e-8)


def test_kmeans_profile_and_pca(spark):
    from retentio.operators import cluster as CL
    from retentio.plans.registry import featured
    feats = featured(spark, SF)
    cl = CL.kmeans_clusters(feats, k=3, n_init=2)
    prof = CL.cluster_profile(cl).toPandas()
    assert prof.Count.sum() == feats.count() and len(prof) == 3
    pc = CL.pca_2d(feats)
    assert pc.columns == ["customerID", "PC1", "PC2", "ChurnLabel"]
    assert CL.pca_2d(feats.drop("Churn")).columns == ["customerID", "PC1", "PC2"]


def test_training_rows_are_dealt_to_the_cores_whatever_their_bytes_are_estimated_at(spark):
    from retentio.operators import models as MD
    assert [MD.training_partitions(n, 12) for n in (0, 150, 4_000, 100_000, 3_000_000, 3_000_001)] == [1, 1, 2, 12, 12, 24]
    rows = spark.range(300)
    joined = rows
    for i in range(8):  # a checkpointed join counts as the product of its inputs
        joined = joined.join(rows.withColumnRenamed("id", f"id{i}"), F.col("id") == F.col(f"id{i}"))
    out = MD.size_partitions(joined.checkpoint(eager=True))
    assert out.rdd.getNumPartitions() == 1 and out.count() == 300
    out.unpersist()
    out = MD.size_partitions(spark.range(40_000))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    out.unpersist()


def test_scan_of_many_models_equals_each_one_alone(spark):
    import numpy as np
    from retentio.operators import cluster as CL
    chance = np.random.default_rng(3)
    x = chance.normal(size=(9_000, 3))
    models = [x[chance.choice(len(x), k, replace=False)] for k in (3, 2, 3, 5)]
    models[3][4] = models[3][1]  # of equal centres the first has the rows
    points = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    for (count, sums, cost), own in zip(CL._scan(points, models, costs=True), models):
        apart = ((x[:, None] - own) ** 2).sum(2)
        near = apart.argmin(1)
        assert count.tolist() == np.bincount(near, minlength=len(own)).tolist()
        assert np.allclose(sums, [x[near == c].sum(0) for c in range(len(own))])
        assert np.isclose(cost, apart.min(1).sum())


def test_a_query_trains_the_models_it_names_only(spark, monkeypatch):
    from retentio.operators import models as MD
    from retentio.plans import model_queries as Q
    from retentio.sources.io import delete_table
    monkeypatch.setattr(Q, "_CACHE", {})
    asked, real = [], MD.train_all

    def train_all(df, label="Churn", names=None, params=None):
        asked.append(list(names))
        return real(df, label, names, params)
    monkeypatch.setattr(MD, "train_all", train_all)
    folder = Q._model_dir(spark, SF, "test-models")
    monkeypatch.setattr(Q, "_model_dir", lambda s, d, kind, real=Q._model_dir: f"{folder}/{real(s, d, kind).rsplit('/', 1)[1]}")
    try:
        rows = Q._report_of("Decision Tree")(spark, SF).collect()
        assert [r["model"] for r in rows] == ["Decision Tree"] and asked == [["Decision Tree"]]
        models, spec = Q.fitted(spark, SF, ["Logistic Regression", "Decision Tree"])
        assert list(models) == ["Logistic Regression", "Decision Tree"] and asked[1:] == [["Logistic Regression"]]
        # A later session loads what is stored.
        Q._CACHE.clear()
        again, same = Q.fitted(spark, SF, ["Decision Tree"])
        assert len(asked) == 2 and same.features == spec.features and again["Decision Tree"].stages[-1].depth == models["Decision Tree"].stages[-1].depth
    finally:
        delete_table(spark, folder)


def test_a_forest_is_scored_by_flat_walks_to_the_last_bit_and_trained_with_kept_places(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from retentio.operators import models as MD
    chance = np.random.default_rng(1)
    x = chance.normal(size=(900, 5)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + chance.normal(scale=0.5, size=900) > 0).astype(int)
    rows = [(f"c{i}", *map(float, r), None if i == 3 else "uv"[i % 2], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double, e double, k string, Churn int").repartition(3).cache()
    params = {"n_estimators": 9, "max_depth": 6}
    model = MD.train_model(df, "Random Forest", params=params)
    real = MD._classifier
    monkeypatch.setattr(MD, "_classifier", lambda *a: real(*a).copy({real(*a).cacheNodeIds: False}))
    other = MD.train_model(df, "Random Forest", params=params)
    trees = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    assert real("Random Forest", "Churn").getCacheNodeIds() and trees(model) == trees(other)
    want = {r[0]: r[1] for r in model.transform(df).select("customerID", vector_to_array("probability")[1]).collect()}
    monkeypatch.setattr(type(model.stages[-1]), "transform", lambda *a: 1 / 0)  # Spark's walk row by row is not used
    scored = MD.score(model, df)
    assert scored.columns == [*df.columns, "churn_prob"]
    assert {r["customerID"]: r["churn_prob"] for r in scored.collect()} == want
    assert MD.score(model, df.limit(0)).count() == 0
