"""Model training, scoring and comparison on Spark ML.

A fitted model is a ``PipelineModel``:

1. ``SQLTransformer`` with the one-hot levels frozen into its statement
   (alphabetical first level dropped, unseen/NULL levels -> all zeros, as
   ``get_dummies(drop_first=True).reindex(fill_value=0)``);
2. ``VectorAssembler`` over the frozen feature list;
3. ``StandardScaler`` and a factor (mean and population sd of the training split);
4. the classifier, trained with a per-row class weight column.

Scoring is ``PipelineModel.transform`` on the whole table; the class-1
probability is ``vector_to_array(probability)[1]``.  Training, scoring and
metrics never collect rows; the driver receives coefficients and level lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from retentio.operators import boosting as B
from retentio.operators import model_metrics as MM
from retentio.operators.clean import DROP_COLS, string_columns
from retentio.operators.features import categorical_levels
from retentio.operators.scalars import with_scalars
from retentio.operators.selection import order_statistics
from retentio.operators.tree_shap import node_table
from retentio.session import ship_code

# Reference model settings (sklearn names in comments).
MODEL_PARAMS = {
    "Logistic Regression": {"C": 1.0, "max_iter": 1000},
    "Decision Tree": {"max_depth": 6, "min_samples_split": 30},
    "Random Forest": {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5},
    "XGBoost": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 6},
    "LightGBM": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 6},
}
# What the two boosting libraries use where the reference sets nothing.
BOOSTER_DEFAULTS = {
    "XGBoost": {"growth": "level", "l2": 1.0, "min_hessian": 1.0, "min_rows": 1, "max_bins": 255, "from_average": False,
                "importance": "gain"},
    "LightGBM": {"growth": "leaf", "num_leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "max_bins": 255, "from_average": True,
                 "importance": "split"},
}
VOTING_MEMBERS = ["Random Forest", "LightGBM", "XGBoost"]


# ------------------------------------------------------------------ split and weights

def stratified_split(df: DataFrame, label: str = "Churn", test_fraction: float = 0.2,
                     seed: int = 42, id_col: str = "customerID") -> DataFrame:
    """M1: exact per-class 80/20 split, seeded.

    Within each class, rows are ordered by ``md5(id || seed)`` (ties by id); the first
    ``round(test_fraction * n_class)`` rows of each class are the test split.  The last test
    row of each class is selected (no sort), and the class's rows are compared with it.
    Rows with a NULL label are dropped.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    lab = df.filter(F.col(label).isNotNull())
    # One row per class; a class's test rows end at the rank after the rows of the classes before it.
    counts = sorted((r[0], r[1]) for r in lab.groupBy(label).count().collect())
    ends, before = {}, 0
    for c, n in counts:
        ends[c] = before + math.floor(n * test_fraction + 0.5)
        before += n
    order = [F.col(label), key, F.col(id_col)]
    found = order_statistics(lab, {"all": order}, {"all": lambda _: list(ends.values())})
    kind = df.schema[id_col].dataType
    own = F.struct(key.alias("h"), F.col(id_col).alias("i"))
    split, begin = F.lit("train"), 0
    for c, n in counts:
        if ends[c] > begin:
            _, h, i = found.keys["all"][ends[c]]
            is_test = (F.col(label) == F.lit(c)) & (own <= F.struct(F.lit(h).alias("h"), F.lit(i).cast(kind).alias("i")))
            split = F.when(is_test, "test").otherwise(split)
        begin += n
    return lab.withColumn("split", split)


def class_weights(df: DataFrame, label: str = "Churn") -> DataFrame:
    """M2: balanced weights n / (2 * n_class) per class (a two-row table)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return (with_scalars(counts, tot)
            .select(label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight")))


def positive_weight(df: DataFrame, label: str = "Churn") -> float:
    """XGBoost-style weight of a positive row: int(neg / pos) over all rows of ``df``, 1 without positives."""
    neg, pos = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return float(neg // pos) if pos else 1.0


def pos_weight_column(df: DataFrame, weight: float, label: str = "Churn") -> DataFrame:
    """Positives get ``weight``, negatives 1."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def with_balanced_weight(df: DataFrame, label: str = "Churn") -> DataFrame:
    w = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(w), label)


# ------------------------------------------------------------------ pipeline

@dataclass
class FeatureSpec:
    """Frozen encoding: categorical levels and the final feature order."""
    categorical: dict[str, list[str]]
    numeric: list[str]
    features: list[str] = field(default_factory=list)

    def sql(self) -> str:
        def q(s: str) -> str:
            return "'" + s.replace("'", "''") + "'"
        exprs = [f"CAST(coalesce(`{c}`, 0) AS DOUBLE)" for c in self.numeric]
        for c, lv in self.categorical.items():
            exprs += [f"CAST(coalesce(`{c}` = {q(v)}, false) AS DOUBLE)" for v in lv[1:]]
        return ("SELECT *, " + ", ".join(f"{e} AS `__f{i}`" for i, e in enumerate(exprs))
                + " FROM __THIS__")


def feature_spec(train: DataFrame, label: str = "Churn", drop: list[str] | None = None,
                 id_col: str = "customerID") -> FeatureSpec:
    drop = set(DROP_COLS if drop is None else drop) | {label, id_col, "split", "weight"}
    cols = [c for c in train.columns if c not in drop]
    cats = [c for c in string_columns(train) if c in cols]
    nums = [c for c in cols if c not in cats]
    levels = categorical_levels(train, cats)
    feats = list(nums) + [f"{c}_{v}" for c in cats for v in levels[c][1:]]
    return FeatureSpec(levels, nums, feats)


def _classifier(name: str, label: str, params: dict | None = None):
    p = dict(MODEL_PARAMS.get(name, {}))
    p.update(params or {})
    common = dict(featuresCol="scaled", labelCol=label, weightCol="weight")
    if name == "Logistic Regression":
        # sklearn: 0.5|w|^2 + C * sum(w_i loss_i); Spark: mean loss + regParam/2 |w|^2
        # regParam is set from the weight sum at fit time (see train_model)
        return LogisticRegression(maxIter=p["max_iter"], elasticNetParam=0.0,
                                  standardization=False, **common)
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=p["max_depth"],
                                      minInstancesPerNode=max(1, p["min_samples_split"] // 2),
                                      seed=42, **common)
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"],
                                      minInstancesPerNode=max(1, p["min_samples_split"] // 2),
                                      # The same trees; rows need not walk them again from the root for each group of nodes.
                                      cacheNodeIds=True, seed=42, **common)
    raise ValueError(f"unknown model {name}")


#: Rows of a partition of a training table: at most, and at least unless there is one partition.
MOST_PARTITION_ROWS, LEAST_PARTITION_ROWS = 250_000, 2_000


def training_partitions(rows: int, cores: int) -> int:
    """A partition for each core, unless they get too small, and whole rounds of the cores where they get too large."""
    if rows > MOST_PARTITION_ROWS * cores:
        return cores * -(-rows // (MOST_PARTITION_ROWS * cores))
    return max(1, min(cores, rows // LEAST_PARTITION_ROWS))


def size_partitions(df: DataFrame) -> DataFrame:
    """Persisted copy, its partitions cut by counted rows and the cluster's cores.

    Iterative learners (boosting rounds, k-means steps) run several small jobs per
    iteration, whose time is the rows' work: it is dealt to all cores, but not finer. Estimated
    bytes would not do: a checkpointed join counts as the product of its inputs. The
    repartition is an exchange: the work before it keeps its own parallelism.
    """
    out = df.repartition(training_partitions(df.count(), df.sparkSession.sparkContext.defaultParallelism)).persist()
    out.count()  # fill the cache once, before concurrent fits read it
    return out


def _encoder(weighted: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """Frozen one-hot encoding, assembler and scaler (training mean and population sd)."""
    enc = SQLTransformer(statement=spec.sql())
    asm = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(spec.features))],
                          outputCol="features", handleInvalid="keep")
    staged = asm.transform(enc.transform(weighted))
    scaler = StandardScaler(inputCol="features", outputCol="scaled_sample", withMean=True, withStd=True).fit(staged)
    # Spark divides by the sample sd; this makes it the population sd.
    n = staged.count()
    ratio = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    population = ElementwiseProduct(scalingVec=Vectors.dense([ratio] * len(spec.features)), inputCol="scaled_sample", outputCol="scaled")
    return PipelineModel([enc, asm, scaler, population])


def train_model(train: DataFrame, name: str, label: str = "Churn", spec: FeatureSpec | None = None,
                params: dict | None = None, pos_weight: float | None = None) -> PipelineModel:
    """Fit one reference model as a PipelineModel on ``train`` (weights added here).

    ``pos_weight`` is XGBoost's weight of a positive row, by default that of ``train``.
    """
    spec = spec or feature_spec(train, label)
    if name in BOOSTER_DEFAULTS:
        return train_boosters(train, [name], label, spec, {name: params or {}}, pos_weight)[name]
    weighted = with_balanced_weight(train, label)
    clf = _classifier(name, label, params)
    if isinstance(clf, LogisticRegression):
        c_val = (params or {}).get("C", MODEL_PARAMS[name]["C"])
        sum_w = weighted.agg(F.sum("weight")).first()[0]
        clf.setRegParam(1.0 / (c_val * sum_w))
    encoder = _encoder(weighted, spec)
    model = PipelineModel([*encoder.stages, clf.fit(encoder.transform(weighted))])
    model._retentio_features = spec.features  # noqa: SLF001 (kept for importances)
    return model


def booster_params(name: str, params: dict | None = None) -> B.BoosterParams:
    p = {**MODEL_PARAMS[name], **BOOSTER_DEFAULTS[name], **(params or {})}
    return B.BoosterParams(rounds=p.pop("n_estimators"), **p)


def train_boosters(train: DataFrame, names: list[str], label: str = "Churn", spec: FeatureSpec | None = None,
                   params: dict | None = None, pos_weight: float | None = None) -> dict[str, PipelineModel]:
    """M6: the boosters as PipelineModels; they share every pass over the rows."""
    spec = spec or feature_spec(train, label)
    balanced = with_balanced_weight(train, label).withColumnRenamed("weight", "_w_LightGBM")
    heavier = positive_weight(train, label) if pos_weight is None else pos_weight
    weighted = pos_weight_column(balanced, heavier, label).withColumnRenamed("weight", "_w_XGBoost")
    encoder = _encoder(weighted, spec)
    fitted = B.fit(encoder.transform(weighted), {n: (booster_params(n, (params or {}).get(n)), f"_w_{n}") for n in names}, label=label)
    out = {n: PipelineModel([*encoder.stages, fitted[n]]) for n in names}
    for m in out.values():
        m._retentio_features = spec.features  # noqa: SLF001
    return out


def score(model: PipelineModel, df: DataFrame, out: str = "churn_prob") -> DataFrame:
    """M8: score a whole table; keeps the input columns and adds ``out``.

    A forest's nodes go to the tasks as flat arrays, and a block of rows walks each tree together.
    """
    if isinstance(model.stages[-1], RandomForestClassificationModel) and (table := node_table(model.stages[-1])).shares is not None:
        ship_code(df.sparkSession)
        cur = PipelineModel(model.stages[:-1]).transform(df)

        @F.pandas_udf("double")
        def vote(x: pd.Series) -> pd.Series:
            return pd.Series(table.vote(np.array(x.tolist(), float)) if len(x) else [], dtype=float)
        return cur.select(*df.columns, vote(vector_to_array(model.stages[-1].getFeaturesCol())).alias(out))
    pred = model.transform(df)
    return pred.select(*df.columns, vector_to_array("probability")[1].alias(out))


def soft_vote(models: dict[str, PipelineModel], df: DataFrame, id_col: str = "customerID",
              out: str = "churn_prob", members: list[str] | None = None) -> DataFrame:
    """M7: mean class-1 probability of the available members (needs >= 2)."""
    members = [m for m in (members or VOTING_MEMBERS) if m in models]
    if len(members) < 2:
        raise ValueError("soft voting needs at least two members")
    cur = df
    for i, m in enumerate(members):
        cur = score(models[m], cur, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(1, len(members))), F.col("_p0")) / len(members)
    return cur.withColumn(out, mean).drop(*[f"_p{i}" for i in range(len(members))])


def evaluate(scored: DataFrame, model_name: str, label: str = "Churn",
             prob: str = "churn_prob") -> DataFrame:
    """M12 + M9/M10 summary row: AUC, AP, accuracy, class-1 P/R/F1 (4 dp)."""
    return MM.comparison(MM.cumulated(MM.long_scores(scored, {model_name: F.col(prob)}, label)))


def train_all(split_df: DataFrame, label: str = "Churn", names: list[str] | None = None,
              params: dict | None = None) -> tuple[dict[str, PipelineModel], FeatureSpec]:
    """Fit every reference model on the train split with one frozen encoding."""
    train = size_partitions(split_df.filter(F.col("split") == "train").drop("split"))
    spec = feature_spec(train, label)
    names = names or list(MODEL_PARAMS)
    boosters = [n for n in names if n in BOOSTER_DEFAULTS]
    # the positive weight counts all rows, not only the training split
    heavier = positive_weight(split_df, label) if boosters else None
    # independent fits run as concurrent Spark jobs (the reference's n_jobs=-1); boosters share theirs
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        futs = {n: pool.submit(train_model, train, n, label, spec, (params or {}).get(n))
                for n in names if n not in boosters}
        if boosters:
            together = pool.submit(train_boosters, train, boosters, label, spec, params, heavier)
        models = {n: f.result() for n, f in futs.items()}
        if boosters:
            models |= together.result()
    train.unpersist()
    return {n: models[n] for n in names}, spec


def model_comparison(models: dict[str, PipelineModel], split_df: DataFrame,
                     label: str = "Churn", with_voting: bool = True) -> DataFrame:
    """One metrics row per model on the test split (voting added when >= 2 members)."""
    return MM.comparison(MM.cumulated(test_scores(models, split_df, label, with_voting)))


def test_scores(models: dict[str, PipelineModel], split_df: DataFrame, label: str = "Churn", with_voting: bool = True,
                id_col: str = "customerID") -> DataFrame:
    """(id, label, model, score) of the test split; every model scores it once, and the vote averages its members' scores."""
    test = split_df.filter(F.col("split") == "test").drop("split")
    scorers = {n: (lambda df, out, m=m: score(m, df, out)) for n, m in models.items()}
    return MM.score_all(test, scorers, ("Voting Ensemble", VOTING_MEMBERS) if with_voting else None, label, (id_col,))


def best_model(comparison: DataFrame) -> DataFrame:
    """Arg-max model by AUC (ties: model name)."""
    # the comparison table has at most six rows; the limit is the arg-max itself
    return (comparison.orderBy(F.col("auc_roc").desc(), F.col("model")).limit(1)
            .select(F.col("model").alias("best_model"), "auc_roc"))


def metric_leaders(comparison: DataFrame,
                   metrics: tuple[str, ...] = ("auc_roc", "avg_precision", "accuracy", "f1_churn")) -> DataFrame:
    """Flag the best value per metric column (the comparison has <= 6 rows)."""
    w = Window.partitionBy(F.lit(1))
    out = comparison
    for m in metrics:
        out = out.withColumn(f"{m}_is_best", F.col(m) == F.max(m).over(w))
    return out


def feature_importance(model: PipelineModel, spark, features: list[str] | None = None) -> DataFrame:
    """Tree importances; else |coefficients|; as (feature, importance)."""
    feats = features or getattr(model, "_retentio_features", None)
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients"):
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    else:
        vals = []
    return spark.createDataFrame(list(zip(feats or [], [float(v) for v in vals])),
                                 "feature string, importance double")


def ensemble_importance(models: dict[str, PipelineModel], spark, features: list[str],
                        members: list[str] | None = None) -> DataFrame:
    """M16 for the voting ensemble: mean of the fitted members' importances (Q9)."""
    members = [m for m in (members or VOTING_MEMBERS) if m in models]
    tabs = [feature_importance(models[m], spark, features) for m in members]
    u = tabs[0]
    for t in tabs[1:]:
        u = u.unionByName(t)
    return u.groupBy("feature").agg(F.avg("importance").alias("importance"))


def importance_rank(importances: DataFrame, top: int = 5) -> DataFrame:
    """W4 + T4: rank features by importance (small table) and flag the top-k."""
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return (importances.withColumn("rank", F.row_number().over(w))
            .withColumn(f"in_top_{top}", F.col("rank") <= top))


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (encoding, scaler and classifier together)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
