"""Churn-rate aggregations: KPIs, breakdowns, grouping sets, pivots, segments.

Rates are ``avg`` of the 0/1 target (NULL targets skipped, as pandas ``mean``);
percentages rounded to 1 dp use exact integer arithmetic (``pct_1dp``).  NULL
group keys are dropped, as pandas ``groupby`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retentio.functions.expr import pct_1dp


def _rate_aggs(target: str = "Churn") -> list[Column]:
    t = F.col(target)
    return [F.count(F.lit(1)).alias("customers"),
            F.sum(t).cast("long").alias("churned"),
            F.avg(t).alias("churn_rate"),
            pct_1dp(F.sum(t), F.count(t)).alias("churn_pct")]


def kpi_overview(df: DataFrame, target: str = "Churn", monthly: str = "MonthlyCharges",
                 tenure: str = "tenure", rate: float = 83.0) -> DataFrame:
    """A1 + X17: one global aggregate row."""
    t = F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(t).cast("long").alias("churned"),
        (F.count(F.lit(1)) - F.coalesce(F.sum(t), F.lit(0))).cast("long").alias("retained"),
        F.avg(t).alias("churn_rate"),
        pct_1dp(F.sum(t), F.count(t)).alias("churn_pct"),
        F.round(F.avg(monthly), 4).alias("avg_monthly"),
        F.round(F.avg(monthly) * F.lit(float(rate)), 4).alias("avg_monthly_inr"),
        F.avg(tenure).alias("avg_tenure"),
    )


def churn_rate_by(df: DataFrame, dim: str, target: str = "Churn",
                  order_desc: bool = False) -> DataFrame:
    """A2 (+T1): churn rate per level of one dimension, NULL level dropped."""
    out = df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(*_rate_aggs(target))
    return out.orderBy(F.col("churn_rate").desc() if order_desc else F.col(dim))


def churn_rate_grouping_sets(df: DataFrame, dims: list[str], target: str = "Churn") -> DataFrame:
    """A3: every single-dimension breakdown in one aggregation (one shuffle).

    Output: (dimension, level, customers, churned, churn_rate, churn_pct); levels
    are strings; a NULL level of the active dimension is dropped.
    """
    g = df.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id(*dims).alias("_gid"), *_rate_aggs(target))
    n = len(dims)
    dim_name = None
    level = None
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # only dimension i is grouped
        cond = F.col("_gid") == gid
        dim_name = F.when(cond, F.lit(d)) if dim_name is None else dim_name.when(cond, F.lit(d))
        lv = F.col(d).cast("string")
        level = F.when(cond, lv) if level is None else level.when(cond, lv)
    return (g.select(dim_name.alias("dimension"), level.alias("level"), "customers", "churned",
                     "churn_rate", "churn_pct")
            .filter(F.col("level").isNotNull()))


def churn_pivot(df: DataFrame, index: str = "InternetService", columns: str = "Contract",
                levels: list[str] | None = None, target: str = "Churn") -> DataFrame:
    """A4: mean churn x 100, index x columns, as conditional aggregation (one pass).

    ``levels`` fixes the output columns (pivot with explicit values); absent
    combinations give NULL, like ``pivot_table``.
    """
    levels = levels or ["Month-to-month", "One year", "Two year"]
    t = F.col(target)
    return (df.filter(F.col(index).isNotNull()).groupBy(index)
            .agg(*[(F.avg(F.when(F.col(columns) == lv, t)) * 100).alias(lv) for lv in levels]))


def segment_summary(df: DataFrame, seg: str = "RFM_Segment", id_col: str = "customerID",
                    target: str = "Churn") -> DataFrame:
    """A5: customers, churn rate/%, mean revenue (2 dp), mean tenure per segment."""
    t = F.col(target)
    return (df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(
        F.count(id_col).alias("Customers"),
        F.avg(t).alias("Churn_Rate"),
        pct_1dp(F.sum(t), F.count(t)).alias("Churn_pct"),
        F.round(F.avg("MonthlyCharges"), 2).alias("Avg_Revenue"),
        F.avg("tenure").alias("Avg_Tenure")))


def segment_rfm_means(df: DataFrame, seg: str = "RFM_Segment") -> DataFrame:
    """Mean R/F/M score per segment."""
    return (df.filter(F.col(seg).isNotNull()).groupBy(seg)
            .agg(F.avg("R_Score").alias("R_Score"), F.avg("F_Score").alias("F_Score"),
                 F.avg("M_Score").alias("M_Score")))


def _cond_rate(cond: Column, target: str = "Churn") -> Column:
    return F.avg(F.when(cond, F.col(target)))


def cohort_rates(df: DataFrame, target: str = "Churn") -> DataFrame:
    """Every filtered churn rate the risk rules use, in one pass (one row)."""
    c = F.col
    return df.agg(
        _cond_rate(c("tenure") <= 12, target).alias("early_churn"),
        _cond_rate(c("tenure") >= 36, target).alias("mature_churn"),
        _cond_rate(c("TechSupport") == "No", target).alias("no_support_churn"),
        _cond_rate(c("TechSupport") == "Yes", target).alias("yes_support_churn"),
        _cond_rate(c("engagement_score") >= 5, target).alias("high_eng_churn"),
        _cond_rate(c("engagement_score") <= 2, target).alias("low_eng_churn"),
        _cond_rate(c("Contract") == "Month-to-month", target).alias("mtm_churn"),
        _cond_rate(c("Contract") == "One year", target).alias("one_year_churn"),
        _cond_rate(c("Contract") == "Two year", target).alias("two_year_churn"),
        F.avg(F.when(c(target) == 1, c("tenure"))).alias("churned_avg_tenure"),
        F.avg(F.when(c(target) == 0, c("tenure"))).alias("retained_avg_tenure"),
        F.count(F.lit(1)).alias("customers"),
    )


# The seven EDA findings (label, predicate column, value).
_FINDINGS = [
    ("Overall churn rate", None, None),
    ("Month-to-month churn", "Contract", "Month-to-month"),
    ("Two-year contract churn", "Contract", "Two year"),
    ("Churners avg tenure", "tenure_churned", None),
    ("Retained avg tenure", "tenure_retained", None),
    ("Fiber optic churn rate", "InternetService", "Fiber optic"),
    ("Electronic check churn", "PaymentMethod", "Electronic check"),
]


def eda_findings(df: DataFrame, target: str = "Churn") -> DataFrame:
    """The seven labelled scalars as (pos, finding, value) rows (one pass + stack)."""
    t = F.col(target)
    vals = []
    for label, col, lv in _FINDINGS:
        if col is None:
            v = F.avg(t)
        elif col == "tenure_churned":
            v = F.avg(F.when(t == 1, F.col("tenure")))
        elif col == "tenure_retained":
            v = F.avg(F.when(t == 0, F.col("tenure")))
        else:
            v = _cond_rate(F.col(col) == lv, target)
        vals.append(v.cast("double"))
    one = df.agg(*[v.alias(f"v{i}") for i, v in enumerate(vals)])
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(lab).alias("finding"),
                               F.col(f"v{i}").alias("value"))
                      for i, (lab, _, _) in enumerate(_FINDINGS)])
    return one.select(F.inline(pairs))


def best_level(df: DataFrame, dim: str = "PaymentMethod", target: str = "Churn") -> DataFrame:
    """Lowest- and highest-churn levels of a dimension (ties: alphabetical first)."""
    rates = (df.filter(F.col(dim).isNotNull()).groupBy(dim)
             .agg(F.avg(target).alias("rate")))
    return rates.agg(
        F.min_by(F.col(dim), F.struct(F.col("rate"), F.col(dim))).alias("best_level"),
        F.min("rate").alias("min_rate"),
        F.min_by(F.col(dim), F.struct(-F.col("rate"), F.col(dim))).alias("worst_level"),
        F.max("rate").alias("max_rate"),
        F.count(F.lit(1)).alias("levels"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Level counts, descending (NULL level dropped, as pandas)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))
