"""Risk scoring, CLV and retention-campaign economics.

Group rates, lifetime and row count are one aggregate row, evaluated once and put into the
plan as literals.  The top-k CLV sums need the value at each strategy's cut-off, which is
selected without a sort; every strategy's sum is then a conditional sum in one pass.
Rounding of lifts and lifetimes is Python's half-to-even, done in exact
integer arithmetic on the underlying counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from retentio.functions.expr import (clv_lookup, clv_roi, clv_simulator, heuristic_score,
                                     retention_action, risk_tier)
from retentio.operators.scalars import with_scalars
from retentio.operators.selection import exact_quantiles_of, order_statistics

# Per-profile money thresholds.  The telecom profile uses the
# reference's values; the orders profile (charges ~550x larger) uses cut-offs
# near the same positions of its own distribution.
PROFILES = {
    "telecom": {"charges_high": 80.0, "clv_mid": 300.0, "clv_high": 500.0},
    "orders": {"charges_high": 48_000.0, "clv_mid": 35_000_000.0, "clv_high": 50_000_000.0},
}

# Strategies with their default cost per customer (INR).
STRATEGIES = [("Premium", "lift_premium", 500), ("Standard", "lift_standard", 200),
              ("Basic", "lift_basic", 100), ("Minimal", "lift_minimal", 10)]

# Fallback contract churn rates (as counts out of 100) and lifts.
_FALLBACK_RATES = {"Month-to-month": 43, "One year": 11, "Two year": 3}
_NO_TARGET_LIFTS = {"lift_premium": 0.40, "lift_standard": 0.30, "lift_basic": 0.18,
                    "lift_minimal": 0.08, "base_churn": 0.265}


def half_even_ratio(a: Column, b: Column) -> Column:
    """round(a / b) with ties to even, exact for integer a and positive integer b."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    r = F.pmod(a, b)
    q = ((a - r) / b).cast("decimal(38,0)")
    twice = r * 2
    return (F.when(twice > b, q + 1).when(twice < b, q)
            .otherwise(q + F.pmod(q, F.lit(2).cast("decimal(38,0)")))).cast("long")


def with_heuristic_score(df: DataFrame, tenure: str = "tenure", out: str = "churn_prob") -> DataFrame:
    """(1 - tenure / max(tenure)) * 0.6 (max is a broadcast one-row aggregate)."""
    mx = df.agg(F.max(tenure).alias("_max_tenure"))
    return (with_scalars(df, mx)
            .withColumn(out, heuristic_score(tenure, "_max_tenure")).drop("_max_tenure"))


def risk_tiers(scored: DataFrame, prob: str = "churn_prob", strict: bool = False) -> DataFrame:
    """X1."""
    return scored.withColumn("risk_tier", risk_tier(prob, strict=strict))


def clv_variants(df: DataFrame, lifetime: Column | int = 12, margin: float = 0.25,
                 rate: float = 83.0) -> DataFrame:
    """The three CLV formulas side by side."""
    return df.select("*",
                     clv_lookup(margin=margin, rate=rate).alias("clv_lookup"),
                     clv_simulator(margin=margin, rate=rate).alias("clv_simulator"),
                     clv_roi(lifetime=lifetime, margin=margin, rate=rate).alias("clv_roi"))


def retention_actions(scored: DataFrame, prob: str = "churn_prob", profile: str = "orders",
                      margin: float = 0.25, rate: float = 83.0) -> DataFrame:
    """Next-best action per customer from (prob, lookup CLV)."""
    p = PROFILES[profile]
    clv = clv_lookup(margin=margin, rate=rate)
    act = retention_action(prob, clv, clv_high=p["clv_high"], clv_mid=p["clv_mid"])
    return scored.select("*", clv.alias("clv"), act.alias("_a")).select(
        *scored.columns, "clv", F.col("_a.action").alias("action"),
        F.col("_a.reason").alias("reason"), F.col("_a.cost").alias("action_cost"),
        F.col("_a.lift_pct").alias("action_lift_pct"))


def lift_rates(df: DataFrame, target: str = "Churn", contract: str = "Contract") -> DataFrame:
    """X11 + X12: data-derived lifts, base churn and implied lifetime (one row)."""
    return campaign_statistics(df, target, contract).drop("customers")


def campaign_statistics(df: DataFrame, target: str = "Churn", contract: str = "Contract") -> DataFrame:
    """``lift_rates`` and the number of rows, from one aggregate."""
    if target not in df.columns:
        fixed = [F.lit(v).alias(k) for k, v in _NO_TARGET_LIFTS.items()]
        return df.agg(F.count(F.lit(1)).alias("customers")).select(*fixed, F.lit(4).cast("long").alias("implied_lifetime"), "customers")
    t, c = F.col(target), F.col(contract)

    def sc(level):
        s = F.sum(F.when(c == level, t)).cast("long")
        n = F.count(F.when(c == level, t))
        fb = _FALLBACK_RATES[level]
        present = n > 0
        return (F.when(present, s).otherwise(F.lit(fb)).cast("long"),
                F.when(present, n).otherwise(F.lit(100)).cast("long"))

    (s1, c1), (s2, c2), (s3, c3) = (sc(lv) for lv in _FALLBACK_RATES)
    one = df.agg(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"),
                 s3.alias("s3"), c3.alias("c3"), F.sum(t).cast("long").alias("s"),
                 F.count(t).alias("c"), F.count(F.lit(1)).alias("customers"))
    d = lambda x: F.col(x).cast("decimal(38,0)")
    k_prem = half_even_ratio(100 * (d("s1") * d("c3") - d("s3") * d("c1")), d("c1") * d("c3"))
    k_std = half_even_ratio(100 * (d("s1") * d("c2") - d("s2") * d("c1")), d("c1") * d("c2"))
    out = one.select(
        (k_prem / 100.0).alias("lift_premium"),
        (k_std / 100.0).alias("lift_standard"),
        (half_even_ratio(6 * k_std, F.lit(10)) / 100.0).alias("lift_basic"),
        (half_even_ratio(k_std, F.lit(4)) / 100.0).alias("lift_minimal"),
        F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("base_churn"),
        F.when(F.col("s") > 0, half_even_ratio(F.col("c"), F.col("s")))
        .otherwise(F.lit(24)).cast("long").alias("implied_lifetime"), "customers",
    )
    return out


def _at_risk_clv(scored: DataFrame, lifetime: int, prob: str, thresh: float, margin: float, rate: float) -> DataFrame:
    """CLV (ROI formula) of the at-risk rows."""
    clv = clv_roi(lifetime=F.lit(int(lifetime)).cast("long"), margin=margin, rate=rate)
    return scored.filter(F.col(prob) >= F.lit(float(thresh))).select(clv.alias("CLV"))


def strategy_comparison(scored: DataFrame, prob: str = "churn_prob", thresh: float = 0.5,
                        margin: float = 0.25, rate: float = 83.0, target: str = "Churn",
                        id_col: str = "customerID", strategies=None,
                        lifetime: int | None = None) -> DataFrame:
    """X13 + X14 + T2: every strategy's campaign economics.

    saved_n = floor(n * lift); revenue saved = CLV sum of the saved_n highest-CLV
    at-risk customers (tie-independent); ROI % = net / cost * 100 (0 if no cost).
    """
    strategies = strategies or STRATEGIES
    # One row, read on the driver: lifts, lifetime and the number of customers.
    facts = campaign_statistics(scored, target).first()
    at = _at_risk_clv(scored, facts["implied_lifetime"] if lifetime is None else lifetime, prob, thresh, margin, rate)
    # A lift can be unknown (null) where a rate is; then nothing is saved.
    saved = lambda n: [math.floor(n * facts[lift]) if facts[lift] is not None else 0 for _, lift, _ in strategies]
    found = order_statistics(at, {"clv": [F.col("CLV")]}, {"clv": lambda n: [n + 1 - k for k in saved(n) if k > 0]})
    n = found.counts["clv"]
    aggs = [F.sum("CLV").alias("clv_at_risk")]
    for (name, _, _), k in zip(strategies, saved(n)):
        cut = found.keys["clv"][n + 1 - min(k, n)][0] if min(k, n) > 0 else None
        above = F.col("CLV") > F.lit(cut).cast("double")
        # Rows equal to the cut fill up the places that larger values leave.
        aggs.append((F.coalesce(F.sum(F.when(above, F.col("CLV"))), F.lit(0.0))
                     + (F.lit(min(k, n)) - F.count_if(above)) * F.lit(cut).cast("double")).alias(f"sv_{name}"))
    base = at.agg(*aggs)
    rows = []
    for i, ((name, lift_col, cost), k) in enumerate(zip(strategies, saved(n))):
        sv = F.coalesce(F.col(f"sv_{name}"), F.lit(0.0)) if k > 0 else F.lit(0.0)
        cc = F.lit(n * cost).cast("long")
        net = sv - cc
        roi = F.when(cc > 0, net / cc * 100).otherwise(F.lit(0.0))
        rows.append(F.struct(
            F.lit(i + 1).alias("pos"), F.lit(name).alias("strategy"),
            F.lit(facts[lift_col]).cast("double").alias("lift"), F.lit(cost).alias("cost_per_customer"),
            F.lit(n).cast("long").alias("n_at_risk"),
            F.lit(n / facts["customers"] if facts["customers"] else None).cast("double").alias("share_of_base"),
            F.round(F.coalesce(F.col("clv_at_risk"), F.lit(0.0)), 2).alias("clv_at_risk"),
            cc.alias("campaign_cost"), F.lit(k if facts[lift_col] is not None else None).cast("long").alias("saved_n"),
            F.round(sv, 2).alias("clv_saved"), F.round(net, 2).alias("net"),
            F.round(roi, 4).alias("roi_pct")))
    return base.select(F.inline(F.array(*rows)))


def campaign_roi(scored: DataFrame, strategy: str = "Premium", **kw) -> DataFrame:
    """One strategy's campaign row."""
    return strategy_comparison(scored, **kw).filter(F.col("strategy") == strategy).drop("pos")


def roi_waterfall(scored: DataFrame, strategy: str = "Premium", **kw) -> DataFrame:
    """(pos, step, value) waterfall rows plus the ROI band of the campaign."""
    c = campaign_roi(scored, strategy, **kw)
    band = (F.when(F.col("roi_pct") > 100, "strong").when(F.col("roi_pct") > 0, "positive")
            .otherwise("negative"))
    steps = F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Revenue Saved").alias("step"),
                 F.col("clv_saved").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit("Campaign Cost").alias("step"),
                 (-F.col("campaign_cost")).cast("double").alias("value")),
        F.struct(F.lit(3).alias("pos"), F.lit("Net").alias("step"), F.col("net").alias("value")))
    return c.select(F.inline(steps), band.alias("roi_band"))


def top_clv_saved(scored: DataFrame, strategy: str = "Premium", **kw) -> DataFrame:
    """k = floor(n * lift) and the CLV sum of the top k at-risk customers."""
    return campaign_roi(scored, strategy, **kw).select("saved_n", "clv_saved")


def contract_lift(df: DataFrame, target: str = "Churn", contract: str = "Contract",
                  baseline: str = "Month-to-month") -> DataFrame:
    """Contract level, churn rate and lift versus the baseline level, by key."""
    rates = (df.filter(F.col(contract).isNotNull()).groupBy(contract)
             .agg(F.avg(target).alias("churn_rate")))
    base = rates.filter(F.col(contract) == baseline).select(F.col("churn_rate").alias("_b"))
    return (with_scalars(rates, base)
            .select(contract, "churn_rate", (F.col("_b") - F.col("churn_rate")).alias("lift_vs_baseline")))


def clv_distribution(scored: DataFrame, prob: str = "churn_prob", thresh: float = 0.5,
                     margin: float = 0.25, rate: float = 83.0, target: str = "Churn",
                     lifetime: int | None = None) -> DataFrame:
    """Count, mean and linear 75th percentile of at-risk CLV."""
    if lifetime is None:
        lifetime = campaign_statistics(scored, target).first()["implied_lifetime"]
    at = _at_risk_clv(scored, lifetime, prob, thresh, margin, rate)
    p75 = exact_quantiles_of(at, ["CLV"], [0.75])["CLV"][0]
    return at.agg(F.count(F.lit(1)).alias("n_at_risk"), F.round(F.avg("CLV"), 2).alias("clv_mean")).withColumn(
        "clv_p75", F.round(F.lit(p75).cast("double"), 2))


__all__ = ["PROFILES", "STRATEGIES", "half_even_ratio", "with_heuristic_score", "risk_tiers",
           "clv_variants", "retention_actions", "lift_rates", "strategy_comparison",
           "campaign_roi", "roi_waterfall", "top_clv_saved", "contract_lift", "clv_distribution",
           "clv_simulator", "clv_roi"]
