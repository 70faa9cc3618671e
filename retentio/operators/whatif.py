"""Risk factors and counterfactual scenarios, batch form.

The reference evaluates one hand-entered profile; here every row of a
profiles table is evaluated.  Group rates are small aggregated tables joined by
broadcast on the level (J1); scenarios are a fixed 6-element array exploded
per profile and filtered by an applicability predicate (J3); global statistics
are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from retentio.functions.expr import SERVICE_COLUMNS, charges_per_month, engagement_score
from retentio.operators.rates import cohort_rates
from retentio.operators.scalars import with_scalars

# Fallback rates used when a statistic is missing.
FALLBACKS = {"mtm_churn": 0.43, "one_year_churn": 0.11, "two_year_churn": 0.03,
             "early_churn": 0.47, "mature_churn": 0.15, "no_support_churn": 0.41,
             "yes_support_churn": 0.15, "high_eng_churn": 0.18, "low_eng_churn": 0.45}


# Fixed values, as are the factors' names below (emoji left out): what a factor says; {r} is its churn rate, {v} the rate it is compared with.
DESCRIPTIONS = {
    "mtm": "Churn rate in your data: {r} vs {v} for two-year contracts",
    "two_year": "Lowest churn in your dataset: {r} churn rate",
    "one_year": "Moderate churn in your dataset: {r} churn rate",
    "early": "Early-tenure customers churn at {r} in your data vs {v} for 36+ months",
    "mature": "Long-tenure customers churn at only {r} in your data",
    "no_support": "Without support: {r} churn vs {v} with support (your data)",
    "support": "Reduces churn from {v} → {r} in your dataset",
    "pay_max": "Highest-churn payment method in your data: {r} churn rate",
    "pay_min": "Lowest-churn payment method in your data: {r} churn rate",
    "high_eng": "5+ services: {r} churn in your data vs {v} for low-engagement",
    "low_eng": "≤2 services: {r} churn in your data — add services to retain",
    "net": "Highest-churn internet type in your data: {r} churn rate",
    "charges": "MonthlyCharges is feature #{r} by importance in your trained model",
    "senior": "Senior customers show higher churn rates in the Telco dataset",
}


def level_rates(df: DataFrame, dim: str, target: str = "Churn", prefix: str = "") -> DataFrame:
    """Churn rate per level of ``dim`` (a table bounded by the level count)."""
    return (df.filter(F.col(dim).isNotNull()).groupBy(dim)
            .agg(F.avg(target).alias(f"{prefix}rate")))


def best_payment(df: DataFrame, target: str = "Churn", dim: str = "PaymentMethod") -> DataFrame:
    """Lowest-churn level (ties: alphabetical first) as a one-row table."""
    r = level_rates(df, dim, target)
    return r.agg(F.min_by(F.col(dim), F.struct(F.col("rate"), F.col(dim))).alias("best_pay"))


def _said(name: str, rate: Column, versus: Column) -> Column:
    """A description with its rates filled in, in percent to one place (the exact value, ties to even)."""
    percent = lambda x: F.concat(F.format_number(x * 100, 1), F.lit("%"))
    text = F.lit(DESCRIPTIONS[name])
    shown = rate.cast("string") if name == "charges" else percent(rate)
    text = F.replace(text, F.lit("{r}"), shown) if "{r}" in DESCRIPTIONS[name] else text
    return F.replace(text, F.lit("{v}"), percent(versus)) if "{v}" in DESCRIPTIONS[name] else text


def _factor(pos: int, cond: Column, label: Column, kind: str, rate: Column | None, desc: str,
            versus: Column | None = None, from_data: bool = True) -> Column:
    none = F.lit(None).cast("double")
    own, other = none if rate is None else rate, none if versus is None else versus
    st = F.struct(F.lit(pos).alias("pos"), label.alias("factor"), F.lit(kind).alias("kind"),
                  (none if desc == "charges" else own).cast("double").alias("rate"),
                  other.cast("double").alias("versus"), _said(desc, own, other).alias("desc"),
                  F.lit(from_data).alias("from_data"))
    return F.when(cond, st)


def risk_factors(profiles: DataFrame, population: DataFrame, target: str = "Churn",
                 importance_top: DataFrame | None = None, charges_high: float = 48_000.0,
                 id_col: str = "customerID") -> DataFrame:
    """Rule-based risk factors per profile, rates taken from ``population``.

    Output (id, pos, factor, kind, rate, versus, desc, from_data), one row per firing rule;
    ``versus`` is the rate that the description compares with.
    The high-charges rule needs model importances (``importance_top``: the
    top-5 features with their rank); without them it is not evaluated.
    """
    stats = cohort_rates(population, target)
    pay = level_rates(population, "PaymentMethod", target, "pay_")
    net = level_rates(population, "InternetService", target, "int_")
    pay_mm = pay.agg(F.max("pay_rate").alias("max_pay"), F.min("pay_rate").alias("min_pay"))
    net_mm = net.agg(F.max("int_rate").alias("max_int"))
    has_contract = population.agg(
        (F.count(F.when(F.col("Contract").isNotNull(), 1)) > 0).alias("has_contract"))
    small = with_scalars(with_scalars(with_scalars(stats, pay_mm), net_mm), has_contract)
    for k, v in FALLBACKS.items():
        small = small.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    j = with_scalars(profiles.join(F.broadcast(pay), "PaymentMethod", "left")
                     .join(F.broadcast(net), "InternetService", "left"), small)
    c = F.col
    eng = c("engagement_score")
    facts = [
        _factor(1, (c("Contract") == "Month-to-month") & c("has_contract"),
                F.lit("Month-to-Month Contract"), "neg", c("mtm_churn"), "mtm",
                c("two_year_churn")),
        _factor(1, c("Contract") == "Two year", F.lit("Two-Year Contract"), "pos",
                c("two_year_churn"), "two_year"),
        _factor(1, c("Contract") == "One year", F.lit("One-Year Contract"), "neu",
                c("one_year_churn"), "one_year"),
        _factor(2, c("tenure") <= 12, F.lit("New Customer (≤12 months)"), "neg", c("early_churn"),
                "early", c("mature_churn")),
        _factor(2, c("tenure") >= 36, F.lit("Long-Tenure Customer (36+ months)"), "pos",
                c("mature_churn"), "mature"),
        _factor(3, (c("TechSupport") == "No") & (c("InternetService") != "No"),
                F.lit("No Tech Support"), "neg", c("no_support_churn"), "no_support",
                c("yes_support_churn")),
        _factor(3, c("TechSupport") == "Yes", F.lit("Tech Support Active"), "pos",
                c("yes_support_churn"), "support", c("no_support_churn")),
        _factor(4, c("pay_rate").isNotNull() & (c("pay_rate") >= c("max_pay") * F.lit(0.9)),
                c("PaymentMethod"), "neg", c("pay_rate"), "pay_max"),
        _factor(4, c("pay_rate").isNotNull() & ~(c("pay_rate") >= c("max_pay") * F.lit(0.9))
                & (c("pay_rate") <= c("min_pay") * F.lit(1.2)), c("PaymentMethod"), "pos",
                c("pay_rate"), "pay_min"),
        _factor(5, eng >= 5, F.format_string("High Engagement (%d/8 services)", eng), "pos",
                c("high_eng_churn"), "high_eng", c("low_eng_churn")),
        _factor(5, eng <= 2, F.format_string("Low Engagement (%d/8 services)", eng), "neg",
                c("low_eng_churn"), "low_eng"),
        _factor(6, c("int_rate").isNotNull() & (c("int_rate") >= c("max_int") * F.lit(0.9)),
                F.concat(c("InternetService"), F.lit(" Internet")), "neg", c("int_rate"), "net"),
    ]
    if importance_top is not None:
        hit = importance_top.agg(F.max(F.lower("feature").contains("monthly")
                                       | F.lower("feature").contains("charges")).alias("_chg"),
                                 F.min(F.when(F.lower("feature").contains("monthly") | F.lower("feature").contains("charges"),
                                              F.col("rank"))).alias("_rank"))
        j = with_scalars(j, hit)
        facts.append(_factor(7, c("_chg") & (c("MonthlyCharges") > F.lit(float(charges_high))),
                             F.format_string("High Monthly Charges (%.0f)", c("MonthlyCharges")), "neg",
                             c("_rank"), "charges"))
    facts.append(_factor(8, c("SeniorCitizen") == 1, F.lit("Senior Citizen"), "neg", None, "senior",
                         from_data=False))
    arr = F.filter(F.array(*facts), lambda x: x.isNotNull())
    return j.select(F.col(id_col), F.inline(arr))


# The counterfactual scenarios (id, name).
SCENARIOS = [(0, "Current Profile"), (1, "Upgrade to Two-Year Contract"),
             (2, "Add Tech Support"), (3, "Switch payment method"),
             (4, "If retained 12 more months"), (5, "Add All Protection Services")]

_PROTECTION = ["TechSupport", "OnlineSecurity", "OnlineBackup", "DeviceProtection"]


def whatif_scenarios(profiles: DataFrame, population: DataFrame,
                     scorer: Callable[[DataFrame], DataFrame], target: str = "Churn",
                     recompute_derived: bool = True, id_col: str = "customerID",
                     prob: str = "churn_prob") -> DataFrame:
    """Every applicable scenario per profile, re-scored, with the delta to baseline.

    ``scorer`` maps a profile table to the same table plus ``prob`` (keeping the
    other columns); the baseline is scored first and carried along, so the
    delta needs no join back.  ``recompute_derived`` re-derives
    engagement_score and charges_per_month from the overridden columns (the
    reference keeps the old values).
    """
    sc = F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(n).alias("scenario"))
                   for i, n in SCENARIOS])
    best = best_payment(population, target)
    c = F.col
    sid = c("scenario_id")
    applies = ((sid == 0) | (sid == 5)
               | ((sid == 1) & (c("Contract") != "Two year"))
               | ((sid == 2) & (c("TechSupport") == "No") & (c("InternetService") != "No"))
               | ((sid == 3) & c("best_pay").isNotNull() & (c("best_pay") != c("PaymentMethod")))
               | ((sid == 4) & (c("tenure") < 60)))
    based = scorer(profiles).withColumnRenamed(prob, "_base")
    x = with_scalars(based, best).select("*", F.inline(sc)).filter(applies)
    over = {
        "Contract": F.when(sid == 1, F.lit("Two year")).otherwise(c("Contract")),
        "TechSupport": F.when(sid.isin(2, 5), F.lit("Yes")).otherwise(c("TechSupport")),
        "PaymentMethod": F.when(sid == 3, c("best_pay")).otherwise(c("PaymentMethod")),
        "tenure": F.when(sid == 4, c("tenure") + 12).otherwise(c("tenure")),
        "TotalCharges": F.when(sid == 4, (c("tenure") + 12) * c("MonthlyCharges"))
                         .otherwise(c("TotalCharges")),
    }
    for s in _PROTECTION[1:]:
        over[s] = F.when(sid == 5, F.lit("Yes")).otherwise(c(s))
    name = F.when(sid == 3, F.concat(F.lit("Switch to "), c("best_pay"))).otherwise(c("scenario"))
    cols = [over.get(col_, c(col_)).alias(col_) for col_ in profiles.columns]
    rows = x.select(*cols, sid.alias("scenario_id"), name.alias("scenario"), c("_base"))
    if recompute_derived:
        svc = [s for s in SERVICE_COLUMNS if s in rows.columns]
        rows = (rows.withColumn("engagement_score", engagement_score(svc))
                .withColumn("charges_per_month", charges_per_month()))
    scored = scorer(rows)
    return scored.withColumn("delta", c(prob) - c("_base")).drop("_base")
