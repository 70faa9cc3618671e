"""Binary-classifier evaluation on a scored table.

Input: a DataFrame with a 0/1 ``label`` and a ``score`` column.  Curves group
rows by distinct score first (ties collapse to one point, as scikit-learn),
then take exact running sums in descending score order with the distributed
running-total operator.  Zero denominators give 0, as ``zero_division=0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retentio.operators.rank import running_totals


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives/negatives per distinct score (partial aggregation map-side)."""
    return (scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("threshold"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"),
                 F.count_if(F.col(label) == 0).alias("neg")))


def _cumulated(scored: DataFrame, label: str, score: str) -> DataFrame:
    sc = score_counts(scored, label, score)
    return running_totals(sc, [F.col("threshold").desc()], {"tp": "pos", "fp": "neg"},
                          with_grand_totals=True)


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M9: (threshold, tp, fp, tpr, fpr) per distinct score, descending, plus the (0, 0) start."""
    cum = _cumulated(scored, label, score)
    pts = cum.select("threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                     _safe_div(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
                     _safe_div(F.col("cum_fp"), F.col("all_fp")).alias("fpr"))
    start = scored.sparkSession.createDataFrame(
        [(float("inf"), 0, 0, 0.0, 0.0)], "threshold double, tp long, fp long, tpr double, fpr double")
    return start.unionByName(pts)


def auc_roc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M9: area under the ROC curve (trapezoids over distinct scores), exact sums.

    AUC = sum_i neg_i * (2 * cum_tp_i - pos_i) / (2 * P * N).
    """
    cum = _cumulated(scored, label, score)
    num = F.sum(F.col("neg").cast("decimal(38,0)") * (2 * F.col("cum_tp") - F.col("pos")))
    den = 2 * F.max("all_tp").cast("decimal(38,0)") * F.max("all_fp").cast("decimal(38,0)")
    return cum.agg(F.when(den > 0, num.cast("double") / den.cast("double")).alias("auc"),
                   F.max("all_tp").alias("positives"), F.max("all_fp").alias("negatives"))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the (recall 0, precision 1) end."""
    cum = _cumulated(scored, label, score)
    pts = cum.select("threshold",
                     _safe_div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
                     _safe_div(F.col("cum_tp"), F.col("all_tp")).alias("recall"))
    end = scored.sparkSession.createDataFrame(
        [(float("inf"), 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def avg_precision(scored: DataFrame, label: str = "label", score: str = "score",
                  digits: int = 10) -> DataFrame:
    """AP = sum over distinct scores of (R_k - R_{k-1}) * P_k (no interpolation)."""
    cum = _cumulated(scored, label, score)
    term = _safe_div(F.col("pos"), F.col("all_tp")) * _safe_div(
        F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    return cum.agg(F.round(F.sum(term), digits).alias("avg_precision"))


def _counts_at(scored: DataFrame, t: float, label: str, score: str) -> list[Column]:
    y, p = F.col(label), F.col(score) >= F.lit(float(t))
    return [F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"),
            F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 0) & ~p).alias("tn")]


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                     score: str = "score") -> DataFrame:
    """(actual, predicted, count) for the four cells, zeros included."""
    one = scored.filter(F.col(label).isNotNull()).agg(*_counts_at(scored, threshold, label, score))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                               F.col(k).alias("count"))
                      for a, p, k in [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]])
    return one.select(F.inline(cells))


def _report_cols(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    return [_safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            _safe_div(tp, tp + fp).alias("precision"),
            _safe_div(tp, tp + fn).alias("recall"),
            _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def classification_report(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                          score: str = "score") -> DataFrame:
    """Accuracy and class-1 precision/recall/F1 (F1 = 2tp / (2tp + fp + fn))."""
    one = scored.filter(F.col(label).isNotNull()).agg(*_counts_at(scored, threshold, label, score))
    return one.select("tp", "fp", "fn", "tn",
                      *_report_cols(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, label: str = "label",
                      score: str = "score") -> DataFrame:
    """Precision, recall, F1, flagged and total at one threshold (``score >= t``)."""
    one = scored.filter(F.col(label).isNotNull()).agg(*_counts_at(scored, threshold, label, score))
    tp, fp, fn, tn = (F.col(k) for k in ["tp", "fp", "fn", "tn"])
    rep = _report_cols(tp, fp, fn, tn)[1:]
    return one.select(F.lit(float(threshold)).alias("threshold"), *rep,
                      (tp + fp).alias("flagged"), (tp + fp + fn + tn).alias("total"))


def sweep_thresholds(start: int = 10, stop: int = 90, step: int = 5) -> list[float]:
    """Thresholds i/100 built from integers (no floating ``arange`` drift)."""
    return [i / 100 for i in range(start, stop + 1, step)]


def threshold_sweep(scored: DataFrame, thresholds: list[float] | None = None,
                    label: str = "label", score: str = "score") -> DataFrame:
    """M13 at every threshold in one pass (conditional counts, then unpivot)."""
    ts = thresholds or sweep_thresholds()
    y = F.col(label)
    aggs = []
    for i, t in enumerate(ts):
        p = F.col(score) >= F.lit(float(t))
        aggs += [F.count_if((y == 1) & p).alias(f"tp{i}"), F.count_if((y == 0) & p).alias(f"fp{i}"),
                 F.count_if((y == 1) & ~p).alias(f"fn{i}"), F.count_if((y == 0) & ~p).alias(f"tn{i}")]
    one = scored.filter(y.isNotNull()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
                              F.col(f"tn{i}").alias("tn")) for i, t in enumerate(ts)])
    long = one.select(F.inline(rows))
    tp, fp, fn, tn = (F.col(k) for k in ["tp", "fp", "fn", "tn"])
    return long.select("threshold", *_report_cols(tp, fp, fn, tn)[1:],
                       (tp + fp).alias("flagged"), (tp + fp + fn + tn).alias("total"))
