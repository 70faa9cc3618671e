"""Behavioural clustering and projection (C1-C4, A7) on Spark ML.

Six numeric features are NULL-filled, assembled and standardised once; the
vector column is persisted for the K-Means iterations and released afterwards.
All restarts of all k run together: one scan of the rows updates the centres of
every model that is still moving.  Of the ``n_init`` seeded starts the one with
the lowest inertia is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from retentio.functions.expr import half_even_quotient
from retentio.operators.clean import decode_target
from retentio.operators.features import standardize
from retentio.session import ship_code

#: Rows that the starting centres are drawn from.
START_ROWS = 10_000
#: Rows whose distances to all centres are held at once.
SCAN_ROWS = 4096

# Clustering features, in order.
CLUSTER_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "engagement_score",
                    "charges_per_month", "SeniorCitizen"]


def cluster_vectors(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Standardised feature vector ``xs`` (population sd) per row."""
    feats = [c for c in (features or CLUSTER_FEATURES) if c in df.columns]
    filled = df.fillna(0, subset=feats)
    scaled = standardize(filled, feats, suffix="_scaled")
    names = [f"{c}_scaled" for c in feats]
    return VectorAssembler(inputCols=names, outputCol="xs").transform(scaled).drop(*names)


def plus_plus(sample: np.ndarray, k: int, chance: np.random.Generator) -> np.ndarray:
    """k starting centres: each drawn in proportion to the squared distance from those before."""
    centres = [sample[chance.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = nearest.sum()
        at = chance.choice(len(sample), p=nearest / total) if total > 0 else chance.integers(len(sample))
        centres.append(sample[at])
        nearest = np.minimum(nearest, ((sample - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For models of as many clusters each (models, clusters, p): every row's cluster (models, rows); ties go to the first."""
    m, k, p = centres.shape
    every = centres.reshape(-1, p)
    # Squared distances without the row's own square, which moves no minimum.
    apart = (-2 * every @ x.T + (every * every).sum(1)[:, None]).reshape(m, k, len(x))
    least, near = apart[:, 0].copy(), np.zeros((m, len(x)), np.int8 if k < 128 else np.int64)
    for c in range(1, k):
        np.putmask(near, apart[:, c] < least, c)
        np.minimum(least, apart[:, c], out=least)
    return near


def _scan(points: DataFrame, models: list[np.ndarray], costs: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass for all models: rows and coordinate sums of every cluster, and with ``costs`` the squared distances."""
    p = models[0].shape[1]
    names = ["m", "c", "n", "cost", *[f"s{j}" for j in range(p)]]
    alike: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        alike.setdefault(len(m), []).append(i)
    stacked = [(np.array(own), np.array([models[i] for i in own])) for own in alike.values()]

    def assign(batches):
        sums = [np.zeros((*c.shape[:2], p + 1)) for _, c in stacked]
        cost = [np.zeros(c.shape[:2]) for _, c in stacked]
        for batch in batches:
            rows = np.asarray(batch.column("x").flatten(), float).reshape(-1, p)
            for at in range(0, len(rows), SCAN_ROWS):
                x = rows[at:at + SCAN_ROWS]
                wide = np.concatenate([x, np.ones((len(x), 1))], 1)
                for (_, centres), total, spent in zip(stacked, sums, cost):
                    near = _nearest(x, centres)
                    k = centres.shape[1]
                    member = (near[:, None] == np.arange(k)[:, None]).astype(float)
                    total += (member.reshape(-1, len(x)) @ wide).reshape(total.shape)
                    for own, own_near, own_spent in zip(centres, near, spent) if costs else ():
                        own_spent += np.bincount(own_near, ((x - own[own_near]) ** 2).sum(1), k)
        flat = [np.concatenate([v.reshape(-1, *v.shape[2:]) for v in part]) for part in (sums, cost)]
        number = np.concatenate([np.repeat(own, c.shape[1]) for own, c in stacked])
        cluster = np.concatenate([np.tile(np.arange(c.shape[1]), len(own)) for own, c in stacked])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(cluster), pa.array(flat[0][:, p]), pa.array(flat[1]),
                                          *[pa.array(flat[0][:, j]) for j in range(p)]], names=names)

    # One row per task and cluster; as many rows as clusters come back.
    parts = points.mapInArrow(assign, "m long, c long, " + ", ".join(f"{c} double" for c in names[2:]))
    out = [(np.zeros(len(m)), np.zeros((len(m), p)), 0.0) for m in models]
    for r in parts.groupBy("m", "c").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        count, sums, cost = out[r["m"]]
        count[r["c"]], sums[r["c"]] = r["n"], [r[f"s{j}"] for j in range(p)]
        out[r["m"]] = count, sums, cost + r["cost"]
    return out


def lloyd_grid(points: DataFrame, starts: dict, max_iter: int = 300, tol: float = 1e-4) -> dict:
    """Lloyd iterations of all models together: {key: (centres, inertia)} from {key: starting centres}.

    ``points`` has an array ``x``. Every scan moves the centres of all models that have not settled
    (no centre moved more than ``tol``); a cluster without rows keeps its centre.
    """
    centres = {k: np.array(c, float) for k, c in starts.items()}
    moving = list(centres)
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for key, (count, sums, _) in zip(moving, _scan(points, [centres[k] for k in moving])):
            new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres[key])
            if ((new - centres[key]) ** 2).sum(1).max() > tol * tol:
                still.append(key)
            centres[key] = new
        moving = still
    keys = list(centres)
    return {k: (centres[k], cost) for k, (_, _, cost) in zip(keys, _scan(points, [centres[k] for k in keys], costs=True))} if keys else {}


def _as_model(spark, centres: np.ndarray) -> KMeansModel:
    """A Spark ML model with these centres, which scores and stores like a fitted one."""
    jvm = spark.sparkContext._jvm
    vectors = jvm.java.util.ArrayList()
    for c in centres:
        vectors.add(jvm.org.apache.spark.mllib.linalg.Vectors.dense(_to_java_array(spark, c)))
    parent = jvm.org.apache.spark.mllib.clustering.KMeansModel(vectors)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("kmeans")
    java = jvm.org.apache.spark.ml.clustering.KMeansModel(uid, parent)
    java.set("featuresCol", "xs")
    java.set("predictionCol", "cluster_id")
    java.set("k", len(centres))
    return KMeansModel(java)


def _to_java_array(spark, values):
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def kmeans_grid(vec: DataFrame, ks, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> dict[int, KMeansModel]:
    """For every k the lowest-cost of ``n_init`` seeded k-means++ starts.

    The starts are drawn from ``START_ROWS`` rows, those of the smallest hash; the iterations of
    all models then share each scan of all rows. Ties in cost keep the earliest seed.
    """
    ship_code(vec.sparkSession)
    points = vec.select(vector_to_array("xs").alias("x"))
    sample = np.array([r["x"] for r in points.orderBy(F.xxhash64("x"), "x").limit(START_ROWS).collect()])
    if not len(sample):
        raise ValueError("no rows to cluster")
    fits = lloyd_grid(points, {(k, i): plus_plus(sample, k, np.random.default_rng([seed + i, k])) for k in ks for i in range(n_init)}, max_iter)
    best = {}
    for k in ks:
        centres, cost = min((fits[k, i] for i in range(n_init)), key=lambda f: f[1])
        best[k] = _as_model(vec.sparkSession, centres)
        best[k].inertia_ = cost
    return best


def best_kmeans(vec: DataFrame, k: int, n_init: int = 10, seed: int = 42,
                max_iter: int = 300) -> KMeansModel:
    """The lowest-cost model among ``n_init`` seeded starts."""
    return kmeans_grid(vec, [k], n_init, seed, max_iter)[k]


def prepared_vectors(df: DataFrame) -> DataFrame:
    """Standardised vectors, dealt to all cores by rows, persisted for the repeated fits."""
    from retentio.operators.models import size_partitions
    return size_partitions(cluster_vectors(df))


def assign_clusters(model: KMeansModel, vec: DataFrame) -> DataFrame:
    return (model.transform(vec).withColumn("Cluster", F.col("cluster_id").cast("string"))
            .drop("cluster_id", "xs"))


def kmeans_clusters(df: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Cluster label (string) per row."""
    vec = prepared_vectors(df)
    try:
        model = best_kmeans(vec, k, n_init, seed)
        return assign_clusters(model, vec).checkpoint(eager=True)
    finally:
        vec.unpersist()


def inertia(model: KMeansModel, vec: DataFrame) -> float:
    """Sum of squared distances to the assigned centres (a Spark aggregate; k x d centres inline)."""
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    pred = model.transform(vec)
    x = vector_to_array(F.col("xs"))
    c = F.element_at(centres, F.col("cluster_id") + 1)
    sq = F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                     lambda acc, v: acc + v)
    return float(pred.agg(F.sum(sq)).first()[0])


def elbow_table(spark, vec: DataFrame, models: dict[int, KMeansModel],
                with_silhouette: bool = True) -> DataFrame:
    """C2 + C3 from fitted models: (k, inertia, silhouette).

    Silhouette is Spark's ``ClusteringEvaluator`` (squared Euclidean, O(n k));
    the exact O(n^2) Euclidean silhouette is not computed.
    """
    ev = ClusteringEvaluator(featuresCol="xs", predictionCol="cluster_id",
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    rows = []
    for k in sorted(models):
        m = models[k]
        sil = ev.evaluate(m.transform(vec)) if with_silhouette else None
        cost = m.inertia_ if hasattr(m, "inertia_") else inertia(m, vec)
        rows.append((k, cost, None if sil is None else float(sil)))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans_elbow(df: DataFrame, ks: range = range(2, 9), n_init: int = 10, seed: int = 42,
                 with_silhouette: bool = True) -> DataFrame:
    """C2 + C3: inertia (and silhouette) per k."""
    vec = prepared_vectors(df)
    try:
        return elbow_table(df.sparkSession, vec, kmeans_grid(vec, ks, n_init, seed),
                           with_silhouette)
    finally:
        vec.unpersist()


def pca_2d(df: DataFrame, id_col: str = "customerID", clusters: KMeansModel | None = None,
           target: str = "Churn") -> DataFrame:
    """C4: first two principal components of the standardised features (sign arbitrary).

    With the fitted ``clusters`` each point also has its cluster, and with a ``target``
    column its Churned/Retained label: the table of the scatter chart.
    """
    vec = cluster_vectors(df)
    model = PCA(k=2, inputCol="xs", outputCol="_pc").fit(vec)
    points = model.transform(vec)
    keep = [F.col(id_col), vector_to_array("_pc")[0].alias("PC1"), vector_to_array("_pc")[1].alias("PC2")]
    if clusters is not None:
        points = clusters.transform(points)
        keep.append(F.col("cluster_id").cast("string").alias("Cluster"))
    if target in df.columns:
        points = decode_target(points, target)
        keep.append(F.col("ChurnLabel"))
    return points.select(*keep)


def cluster_profile(clustered: DataFrame, target: str = "Churn", id_col: str = "customerID") -> DataFrame:
    """Count, churn %, mean tenure and monthly charge per cluster."""
    t = F.col(target)
    return clustered.groupBy("Cluster").agg(
        F.count(id_col).alias("Count"),
        # the rate is rounded to two places before it becomes a percentage
        half_even_quotient(F.lit(100) * F.sum(t), F.count(t)).cast("double").alias("Churn_Rate_pct"),
        F.round(F.avg("tenure"), 2).alias("Avg_Tenure"),
        F.round(F.avg("MonthlyCharges"), 2).alias("Avg_Monthly"))
