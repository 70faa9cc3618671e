"""Curve and threshold metrics against their definitions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from retentio.operators import metrics as M


def _scored(spark, labels, scores):
    return spark.createDataFrame([(int(l), float(s)) for l, s in zip(labels, scores)],
                                 "label int, score double")


def _pair_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_equals_pair_count_with_ties(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 200)
    scores = np.round(rng.random(200), 1)  # many ties
    auc = M.auc_roc(_scored(spark, labels, scores)).first().auc
    assert abs(auc - _pair_auc(labels, scores)) < 1e-12


def test_roc_monotone_and_bounds(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 150)
    scores = rng.random(150)
    roc = M.roc_curve(_scored(spark, labels, scores)).toPandas().sort_values(
        "threshold", ascending=False)
    assert roc.tpr.is_monotonic_increasing and roc.fpr.is_monotonic_increasing
    assert roc.iloc[0][["tpr", "fpr"]].tolist() == [0.0, 0.0]
    assert roc.iloc[-1][["tpr", "fpr"]].tolist() == [1.0, 1.0]


def test_average_precision_definition(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 120)
    scores = np.round(rng.random(120), 2)
    ap = M.avg_precision(_scored(spark, labels, scores)).first().avg_precision
    order = sorted(set(scores), reverse=True)
    P = labels.sum()
    exp, prev_r = 0.0, 0.0
    for t in order:
        flag = scores >= t
        tp = (labels[flag] == 1).sum()
        prec, rec = tp / flag.sum(), tp / P
        exp += (rec - prev_r) * prec
        prev_r = rec
    assert abs(ap - exp) < 1e-9


def test_one_class_and_empty(spark):
    one = _scored(spark, [1, 1, 1], [0.2, 0.5, 0.9])
    assert M.auc_roc(one).first().auc is None
    rep = M.classification_report(one, 0.5).first()
    assert rep.recall == 2 / 3 and rep.precision == 1.0
    empty = spark.createDataFrame([], "label int, score double")
    r = M.threshold_metrics(empty, 0.5).first()
    assert (r.precision, r.recall, r.f1, r.flagged, r.total) == (0.0, 0.0, 0.0, 0, 0)


def test_sweep_recall_non_increasing(spark):
    rng = np.random.default_rng(4)
    sw = M.threshold_sweep(_scored(spark, rng.integers(0, 2, 100), rng.random(100))).toPandas()
    assert len(sw) == 17 and sw.threshold.tolist() == [i / 100 for i in range(10, 91, 5)]
    assert sw.sort_values("threshold").recall.is_monotonic_decreasing


def test_confusion_matrix_cells(spark):
    cm = M.confusion_matrix(_scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.1, 0.2]), 0.5)
    got = {(r.actual, r.predicted): r["count"] for r in cm.collect()}
    assert got == {(1, 1): 1, (0, 1): 1, (1, 0): 1, (0, 0): 1}
