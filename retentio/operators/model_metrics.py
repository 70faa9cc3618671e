"""Curves and metrics of several models over one scored table.

The scored table is long: one row per (row, model) with ``label`` and ``score``. Rows are counted
by (model, score) in the tasks; one sort in the order (model, score descending) gives running
totals over all models, and a model's own totals are those minus what the models before it hold.
So the curves of all models cost one sort, and every member of a model set is scored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from retentio.operators.metrics import _report_cols, _safe_div, sweep_thresholds
from retentio.operators.rank import running_totals


def long_scores(df: DataFrame, scores: dict[str, Column], label: str = "Churn", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row and score: the ``keep`` columns, ``label``, ``model`` and ``score``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), s.cast("double").alias("score")) for n, s in scores.items()])
    return df.select(*keep, F.col(label).alias("label"), F.inline(pairs))


def cumulated(scored: DataFrame) -> DataFrame:
    """Per model and distinct score: ``pos``, ``neg``, their running totals by falling score, and the model's totals."""
    known = scored.filter(F.col("label").isNotNull() & F.col("score").isNotNull())
    counts = known.groupBy("model", F.col("score").cast("double").alias("threshold")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    run = running_totals(counts, [F.col("model"), F.col("threshold").desc()], {"tp": "pos", "fp": "neg"})
    # One row per model, whose number the caller chose.
    totals = run.groupBy("model").agg(F.sum("pos").alias("all_tp"), F.sum("neg").alias("all_fp"))
    before = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("*", *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in ("tp", "fp")])
    return run.join(F.broadcast(offsets), "model").select(
        "model", "threshold", "pos", "neg", *[(F.col(f"cum_{k}") - F.col(f"_{k}")).alias(f"cum_{k}") for k in ("tp", "fp")],
        "all_tp", "all_fp")


def _with_end(points: DataFrame, cum: DataFrame, **end: float) -> DataFrame:
    """The points and, for every model, the curve's end that belongs to no score."""
    kinds = dict(points.dtypes)
    ends = cum.select("model").distinct().select("model", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in end.items()])
    return points.unionByName(ends)


def roc_curves(cum: DataFrame) -> DataFrame:
    """M9 per model: (model, threshold, tp, fp, tpr, fpr), with the (0, 0) start."""
    points = cum.select("model", "threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                        _safe_div(F.col("cum_tp"), F.col("all_tp")).alias("tpr"), _safe_div(F.col("cum_fp"), F.col("all_fp")).alias("fpr"))
    return _with_end(points, cum, threshold=float("inf"), tp=0, fp=0, tpr=0.0, fpr=0.0)


def pr_curves(cum: DataFrame) -> DataFrame:
    """M10 per model: (model, threshold, precision, recall), with the (recall 0, precision 1) end."""
    points = cum.select("model", "threshold", _safe_div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
                        _safe_div(F.col("cum_tp"), F.col("all_tp")).alias("recall"))
    return _with_end(points, cum, threshold=float("inf"), precision=1.0, recall=0.0)


def summaries(cum: DataFrame, threshold: float = 0.5, digits: int = 10) -> DataFrame:
    """M9, M10 and M12 per model from the same totals: AUC, average precision, and the report at ``threshold``."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    num = F.sum(exact("neg") * (2 * F.col("cum_tp") - F.col("pos")))
    den = 2 * F.max(exact("all_tp")) * F.max(exact("all_fp"))
    term = _safe_div(F.col("pos"), F.col("all_tp")) * _safe_div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    flagged = F.col("threshold") >= F.lit(float(threshold))
    at = lambda c: F.coalesce(F.sum(F.when(flagged, F.col(c))), F.lit(0))
    rows = cum.groupBy("model").agg(
        F.when(den > 0, num.cast("double") / den.cast("double")).alias("auc"), F.round(F.sum(term), digits).alias("avg_precision"),
        at("pos").alias("tp"), at("neg").alias("fp"), F.max("all_tp").alias("_p"), F.max("all_fp").alias("_n"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("_p") - F.col("tp"), F.col("_n") - F.col("fp")
    return rows.select("model", "auc", "avg_precision", tp, fp, fn.alias("fn"), tn.alias("tn"), *_report_cols(tp, fp, fn, tn))


def _counts(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(model, threshold, tp, fp, fn, tn): one pass of conditional counts."""
    y = F.col("label")
    aggs = []
    for i, t in enumerate(thresholds):
        p = F.col("score") >= F.lit(float(t))
        aggs += [F.count_if(c).alias(f"{k}{i}") for k, c in (("tp", (y == 1) & p), ("fp", (y == 0) & p), ("fn", (y == 1) & ~p), ("tn", (y == 0) & ~p))]
    one = scored.filter(y.isNotNull()).groupBy("model").agg(*aggs)
    return one.select("model", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(thresholds)])))


def confusion_matrices(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M11 per model: (model, actual, predicted, count) for all four cells."""
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    return _counts(scored, [threshold]).select("model", F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(k).alias("count")) for a, p, k in cells])))


def threshold_sweeps(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """M13 and M14 per model: precision, recall, F1, flagged and total at every threshold."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return _counts(scored, thresholds or sweep_thresholds()).select(
        "model", "threshold", *_report_cols(tp, fp, fn, tn)[1:], (tp + fp).alias("flagged"), (tp + fp + fn + tn).alias("total"))


def comparison(cum: DataFrame) -> DataFrame:
    """One row of rounded metrics per model."""
    names = {"auc": "auc_roc", "avg_precision": "avg_precision", "accuracy": "accuracy", "precision": "precision_churn",
             "recall": "recall_churn", "f1": "f1_churn"}
    return summaries(cum).select("model", *[F.round(k, 4).alias(v) for k, v in names.items()])


def score_all(df: DataFrame, scorers: dict[str, Callable[[DataFrame, str], DataFrame]], vote: tuple[str, list[str]] | None = None,
              label: str = "Churn", keep: tuple[str, ...] = ("customerID",)) -> DataFrame:
    """Long scores of every model; ``scorers`` add a column to a table, and ``vote`` (name, members) averages members' scores."""
    cur, columns = df, {}
    for i, (name, scorer) in enumerate(scorers.items()):
        cur, columns[name] = scorer(cur, f"_p{i}"), F.col(f"_p{i}")
    members = [m for m in vote[1] if m in columns] if vote else []
    if len(members) >= 2:
        columns[vote[0]] = sum((columns[m] for m in members[1:]), columns[members[0]]) / len(members)
    return long_scores(cur, columns, label, keep)
