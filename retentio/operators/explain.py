"""Per-customer attributions and reasons.

* Linear models: exact attribution ``coef_j * (x_j - mean_j)`` in the scaled
  space the model was trained in; the training mean of a scaled feature is 0,
  so it is ``coef_j * xs_j`` and the attributions sum to ``logit - mean logit``
  (the reference's linear explainer used the row itself as background, Q8).
* Any model: Shapley sampling (trees have exact values, see ``tree_shap``).  For each customer and each of ``m`` seeded
  permutations the features are switched from the background (training mean,
  i.e. 0 in scaled space) to the customer's value one at a time; the change in
  the class-1 probability is that feature's contribution; averaged over
  permutations.  Trees and forests are walked once for all steps of a
  customer (``tree_sampling``).  Other models score customers x m x
  (features + 1) rows in one ``transform``, summed by (customer, feature);
  no window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from retentio.operators.features import standardize
from retentio.operators.tree_sampling import orders_of, sampled_values
from retentio.operators.tree_shap import NodeTable, node_table
from retentio.session import ship_code

#: Scored rows of a task of the sampling explainer.
SCORED_ROWS_PER_TASK = 250_000
#: Rows of a task, walked down the trees together; a task has fewer, down to the least, where that keeps all cores at work.
WALKED_ROWS, LEAST_WALKED = 16_384, 1_000


def _scaled(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows through the encoding, assembler and scaler stages (not the classifier)."""
    cur = df
    for st in model.stages[:-1]:
        cur = st.transform(cur)
    return cur


def shap_linear(model: PipelineModel, df: DataFrame, features: list[str],
                id_col: str = "customerID") -> DataFrame:
    """X5 (linear): (id, feature, value, shap) for every customer and feature."""
    return shap_linear_arrays(model, df, features, id_col).select(id_col, F.inline("attr"))


def shap_linear_arrays(model: PipelineModel, df: DataFrame, features: list[str],
                       id_col: str = "customerID") -> DataFrame:
    """X5 (linear): one row per customer with an array of (feature, value, shap)."""
    clf = model.stages[-1]
    coef = clf.coefficients.toArray().tolist()
    xs = _scaled(model, df).select(id_col, vector_to_array("scaled").alias("_xs"),
                                   vector_to_array("features").alias("_x"))
    coefs = F.array(*[F.lit(float(c)) for c in coef])
    names = F.array(*[F.lit(f) for f in features])
    z = F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_xs").alias("xs"),
                     coefs.alias("coef"))
    return xs.select(id_col, F.transform(z, lambda s: F.struct(
        s["feature"].alias("feature"), s["value"].alias("value"), (s["coef"] * s["xs"]).alias("shap"))).alias("attr"))


def shap_weights_arrays(df: DataFrame, weights: dict[str, float], id_col: str = "customerID", digits: int = 8) -> DataFrame:
    """X5 of a linear score given by its weights on standardised (population sd) columns of ``df``.

    The background is the table's own mean; a column of one value attributes 0, a NULL one NULL.
    """
    scaled = standardize(df, list(weights), suffix="__z")
    return scaled.select(id_col, F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"),
                 F.round(F.lit(float(w)) * F.col(f"`{c}__z`"), digits).alias("shap")) for c, w in weights.items()]).alias("attr"))


def shap_sampled(model: PipelineModel, df: DataFrame, features: list[str], m: int = 8,
                 seed: int = 42, id_col: str = "customerID") -> DataFrame:
    """X5 (trees): sampled Shapley values, (id, feature, value, shap)."""
    p = len(features)
    clf = model.stages[-1]
    base = _scaled(model, df).select(id_col, vector_to_array("scaled").alias("_xs"),
                                     vector_to_array("features").alias("_x"))
    if isinstance(clf, (DecisionTreeClassificationModel, RandomForestClassificationModel)):
        return _sampled_by_walks(base, node_table(clf), features, m, seed, id_col)
    # A row becomes m * (p + 1) scored ones: tasks are cut by those, not by the bytes read.
    base = base.repartition(max(1, -(-base.count() * m * (p + 1) // SCORED_ROWS_PER_TASK)))
    idx = F.sequence(F.lit(0), F.lit(p - 1))
    perm = F.transform(
        F.array_sort(F.transform(idx, lambda i: F.struct(
            F.xxhash64(F.col(id_col), F.col("_m"), i, F.lit(seed)).alias("h"), i.alias("i")))),
        lambda s: s["i"])
    # rank of each feature inside the permutation
    rank = F.transform(idx, lambda i: F.array_position(F.col("_perm"), i) - 1)
    rows = (base.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
            .withColumn("_perm", perm)
            .withColumn("_rank", rank)
            .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(p))))
            .withColumn("_masked", F.transform(
                idx, lambda i: F.when(F.col("_rank")[i] < F.col("_j"), F.col("_xs")[i])
                .otherwise(F.lit(0.0))))
            .withColumn("scaled", array_to_vector("_masked")))
    pred = clf.transform(rows.select(id_col, "_j", "_perm", "_x", "scaled"))
    f = vector_to_array("probability")[1]
    # Row j has the first j features switched on: it closes the step of feature perm[j - 1]
    # and opens that of perm[j]. Summed by feature in the tasks, nothing needs an order.
    part = lambda at, sign: F.struct(
        F.get("_perm", at).alias("i"), F.get("_x", F.get("_perm", at).cast("int")).alias("value"), (sign * F.col("_f")).alias("d"))
    steps = (pred.select(id_col, "_j", "_perm", "_x", f.alias("_f"))
             .select(id_col, F.explode(F.filter(F.array(part(F.col("_j") - 1, 1.0), part(F.col("_j"), -1.0)),
                                                lambda s: s["i"].isNotNull())).alias("_s")))
    names = F.array(*[F.lit(f) for f in features])
    return (steps.groupBy(id_col, F.col("_s.i").alias("_fi"))
            .agg((F.sum("_s.d") / m).alias("shap"), F.max("_s.value").alias("value"))
            .select(id_col, names[F.col("_fi")].alias("feature"), "value", "shap"))


def _sampled_by_walks(base: DataFrame, table: NodeTable, features: list[str], m: int, seed: int, id_col: str) -> DataFrame:
    """Sampled Shapley values of additive trees; the same permutations and steps as the scored rows have."""
    p = len(features)
    rows, cores = base.count(), base.sparkSession.sparkContext.defaultParallelism
    # Whole rounds of the cores; fewer tasks only where they would get too small.
    tasks = max(1, min(cores * -(-rows // (WALKED_ROWS * cores)), rows // LEAST_WALKED))
    hashes = F.transform(F.sequence(F.lit(0), F.lit(m * p - 1)), lambda k: F.xxhash64(
        F.col(id_col), F.floor(k / p).cast("int"), (k % p).cast("int"), F.lit(seed)))
    kind = base.schema[id_col].dataType.simpleString()

    def attributed(held):
        ids, x, value, order = (pa.concat_arrays([b.column(c) for b in held]) for c in (id_col, "_xs", "_x", "_order"))
        n = len(ids)
        phi = sampled_values(table, np.asarray(x.flatten()).reshape(n, p), orders_of(np.asarray(order.flatten()).reshape(n, m, p)))
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * p)
        return pa.RecordBatch.from_arrays([ids, value, pa.ListArray.from_arrays(offsets, pa.array(phi.ravel()))], names=[id_col, "value", "shap"])

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, WALKED_ROWS):
                held.append(whole.slice(at, WALKED_ROWS))
                n += held[-1].num_rows
                if n >= WALKED_ROWS:
                    yield attributed(held)
                    held, n = [], 0
        if held:
            yield attributed(held)

    ship_code(base.sparkSession)
    done = (base.repartition(tasks).withColumn("_order", hashes)
            .mapInArrow(run, f"{id_col} {kind}, value array<double>, shap array<double>"))
    names = F.array(*[F.lit(f) for f in features])
    steps = done.select(id_col, F.posexplode(F.arrays_zip("value", "shap")).alias("_fi", "_s"))
    # Rows that share an id have one attribution together; without such rows there is nothing to sum.
    if base.groupBy(id_col).count().filter("count > 1").limit(1).count():
        steps = steps.groupBy(id_col, "_fi").agg(F.struct(F.max("_s.value").alias("value"), F.sum("_s.shap").alias("shap")).alias("_s"))
    return steps.select(id_col, names[F.col("_fi")].alias("feature"), "_s.value", "_s.shap")


def as_arrays(attr: DataFrame, id_col: str = "customerID") -> DataFrame:
    """Long attributions as one row per customer with an array of (feature, value, shap)."""
    return attr.groupBy(id_col).agg(F.collect_list(F.struct("feature", "value", "shap")).alias("attr"))


def _by(keys):
    """Comparator of attributions: ``keys`` gives the values to compare, smaller first."""
    def compare(a, b):
        out = F.lit(0)
        for x, y in reversed(list(zip(keys(a), keys(b)))):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out
    return compare


def _largest(attr: DataFrame, k: int, id_col: str) -> DataFrame:
    rows = attr if "attr" in attr.columns else as_arrays(attr, id_col)
    strongest = F.array_sort("attr", _by(lambda s: (-F.abs(s["shap"]), s["feature"])))
    return rows.select(id_col, F.array_sort(F.slice(strongest, 1, k), _by(lambda s: (s["shap"], s["feature"]))).alias("attr"))


def top_attributions(attr: DataFrame, k: int = 12, id_col: str = "customerID") -> DataFrame:
    """Per customer the k largest |shap|, re-ordered by signed value (pos 1 = most negative).

    ``attr`` has one row per customer with an array (no shuffle), or is long.
    """
    return _largest(attr, k, id_col).select(id_col, F.posexplode("attr").alias("_p", "_s")).select(
        id_col, "_s.feature", "_s.value", "_s.shap", (F.col("_p") + 1).alias("pos"))


def attribution_reasons(attr: DataFrame, k: int = 12, up: int = 3, down: int = 2,
                        id_col: str = "customerID") -> DataFrame:
    """Among the top-k attributions, the 3 strongest risk drivers and 2 strongest reducers."""
    top = _largest(attr, k, id_col)
    ups = F.slice(F.array_sort(F.filter("attr", lambda s: s["shap"] > 0), _by(lambda s: (-s["shap"], s["feature"]))), 1, up)
    dns = F.slice(F.filter("attr", lambda s: s["shap"] < 0), 1, down)
    named = lambda arr, text: F.transform(arr, lambda s, i: F.struct(
        F.lit(text).alias("direction"), (i + 1).alias("rank"), s["feature"].alias("feature"),
        s["value"].alias("value"), s["shap"].alias("shap")))
    return top.select(id_col, F.inline(F.concat(named(ups, "increases risk"), named(dns, "reduces risk"))))
