"""Unit tests on hand-made rows (FIXTURES section 2)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import raw_row
from retentio.functions.expr import quintile_from_rank, segment_label
from retentio.operators import clean as C
from retentio.operators import features as FE
from retentio.operators import roi as X
from retentio.operators.profile import target_correlation


def test_tenure_edges(raw_df_factory):
    tenures = [0, 1, 12, 13, 24, 25, 48, 49, 72, 73]
    df = raw_df_factory([raw_row(f"C{t}", tenure=t) for t in tenures])
    got = {r.tenure: r.tenure_group for r in FE.add_tenure_group(df).collect()}
    exp = pd.cut(pd.Series(tenures), bins=[0, 12, 24, 48, 72],
                 labels=['0-12 months', '12-24 months', '24-48 months', '48+ months'], right=True)
    for t, e in zip(tenures, exp):
        assert got[t] == (None if pd.isna(e) else e)
    assert got[0] is None and got[73] is None


def test_dirty_cleaning(raw_df_factory):
    rows = [raw_row("A", TotalCharges=" "), raw_row("B", TotalCharges="abc"),
            raw_row("C", TotalCharges=" 12.5 ", Churn="Yes "), raw_row("D", Churn="maybe"),
            raw_row("E"), raw_row("E"), raw_row("F", gender="Male "), raw_row("F")]
    out = C.clean_subscribers(raw_df_factory(rows))
    res = sorted(out.select("customerID", "TotalCharges", "Churn", "gender").collect())
    by = {}
    for r in res:
        by.setdefault(r.customerID, []).append(r)
    assert by["A"][0].TotalCharges == 0.0 and by["B"][0].TotalCharges == 0.0
    assert by["C"][0].TotalCharges == 12.5 and by["C"][0].Churn is None  # mapped before trim
    assert by["D"][0].Churn is None
    assert len(by["E"]) == 1                      # exact duplicate dropped
    assert len(by["F"]) == 2                      # twin differs before trim: both kept
    assert {r.gender for r in by["F"]} == {"Male"}  # ... and trimmed afterwards


def test_engagement_services(raw_df_factory):
    svc = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
           "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
    rows = []
    for k in range(9):
        kw = {c: ("Yes" if i < k else "No internet service") for i, c in enumerate(svc)}
        rows.append(raw_row(f"S{k}", **kw))
    rows.append(raw_row("SN", PhoneService=None))
    got = {r.customerID: r.engagement_score for r in FE.add_engagement(raw_df_factory(rows)).collect()}
    for k in range(9):
        assert got[f"S{k}"] == k
    assert got["SN"] == 0


@pytest.mark.parametrize("n", list(range(2, 60)))
def test_quintile_formula_matches_qcut_of_ranks(spark, n):
    ranks = np.arange(1, n + 1)
    exp = pd.qcut(pd.Series(ranks, dtype=float), q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    df = spark.createDataFrame([(int(r), n) for r in ranks], "rn long, n long")
    got = [r[0] for r in df.select(quintile_from_rank("rn", "n")).collect()]
    assert got == exp


def test_ntile_is_not_the_formula(spark):
    n = 7
    ranks = np.arange(1, n + 1)
    exp = pd.qcut(pd.Series(ranks, dtype=float), q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    from pyspark.sql import Window
    df = spark.createDataFrame([(int(r),) for r in ranks], "rn long")
    nt = [r[0] for r in df.select(F.ntile(5).over(Window.orderBy("rn"))).collect()]
    assert nt != exp


def test_rfm_scores_ties_and_segments(raw_df_factory):
    # frequency ties broken by customerID ascending
    rows = [raw_row(f"C{i:02d}", tenure=i % 7 + 1, TotalCharges=str(100 + i % 4),
                    PhoneService="Yes" if i % 2 else "No") for i in range(23)]
    feat = FE.all_features(C.clean_subscribers(raw_df_factory(rows)), num_partitions=3)
    pdf = feat.toPandas().sort_values("customerID").reset_index(drop=True)
    exp_f = pd.qcut(pdf["frequency"].rank(method="first"), q=5, labels=[1, 2, 3, 4, 5]).astype(int)
    exp_m = pd.qcut(pdf["monetary"].rank(method="first"), q=5, labels=[1, 2, 3, 4, 5]).astype(int)
    exp_r = pd.qcut(pdf["recency"], q=5, labels=[5, 4, 3, 2, 1], duplicates="drop").astype(int)
    assert pdf["F_Score"].tolist() == exp_f.tolist()
    assert pdf["M_Score"].tolist() == exp_m.tolist()
    assert pdf["R_Score"].tolist() == exp_r.tolist()


@pytest.mark.parametrize("score,label", [(3, "Lost"), (4, "At Risk"), (5, "At Risk"),
                                         (6, "Potential Loyalists"), (8, "Potential Loyalists"),
                                         (9, "Loyal Customers"), (11, "Loyal Customers"),
                                         (12, "Champions"), (15, "Champions")])
def test_segment_edges(spark, score, label):
    assert spark.range(1).select(segment_label(F.lit(score))).first()[0] == label


def test_risk_tiers_and_actions(spark):
    rows = [(0.349, 299.0), (0.35, 300.0), (0.649, 499.0), (0.65, 500.0)]
    df = spark.createDataFrame(rows, "churn_prob double, CLV double")
    tiers = [r[0] for r in X.risk_tiers(df).select("risk_tier").collect()]
    assert tiers == ["LOW RISK", "MEDIUM RISK", "MEDIUM RISK", "HIGH RISK"]
    strict = [r[0] for r in X.risk_tiers(df, strict=True).select("risk_tier").collect()]
    assert strict == ["LOW RISK", "LOW RISK", "MEDIUM RISK", "MEDIUM RISK"]
    from retentio.functions.expr import retention_action
    acts = [r[0] for r in df.select(retention_action("churn_prob", "CLV").action).collect()]
    assert acts == ["Monitor — Low Risk", "Loyalty Rewards + Upgrade Offer",
                    "Loyalty Rewards + Upgrade Offer", "Personal Manager + 20% Discount"]
    low_clv = spark.createDataFrame([(0.5, 10.0), (0.7, 10.0)], "churn_prob double, CLV double")
    acts = [r[0] for r in low_clv.select(retention_action("churn_prob", "CLV").action).collect()]
    assert acts == ["Automated Re-engagement", "Targeted 15% Discount"]


def test_frozen_encoding_unseen_and_null(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    levels = FE.categorical_levels(train, ["x"])
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "x string")
    out = FE.one_hot(new, levels, drop_first=True).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 0)]
    assert FE.one_hot(new, levels).columns == ["x_a", "x_b", "x_c"]


def test_standardize_population_sd(spark):
    df = spark.createDataFrame([(float(v),) for v in range(13)], "x double")
    out = [r[0] for r in FE.standardize(df, ["x"]).orderBy("x").collect()]
    vals = np.arange(13, dtype=float)
    exp = (vals - vals.mean()) / vals.std()
    assert np.allclose(out, exp)
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in FE.standardize(const, ["x"]).collect()] == [0.0, 0.0]


def test_lift_rates_half_even_and_guards(spark):
    # mtm 3/7, one 1/7, two absent (fallback 3/100)
    rows = ([("Month-to-month", 1)] * 3 + [("Month-to-month", 0)] * 4
            + [("One year", 1)] + [("One year", 0)] * 6)
    df = spark.createDataFrame(rows, "Contract string, Churn int")
    r = X.lift_rates(df).first()
    assert r.lift_premium == round(3 / 7 - 0.03, 2)
    assert r.lift_standard == round(3 / 7 - 1 / 7, 2)
    assert r.lift_basic == round(r.lift_standard * 0.6, 2)
    assert r.implied_lifetime == round(14 / 4)
    none = spark.createDataFrame([("One year", 0)], "Contract string, Churn int")
    assert X.lift_rates(none).first().implied_lifetime == 24


def test_campaign_roi_guards(spark):
    rows = [(f"C{i}", 0, 1, 100.0 + i, "Month-to-month") for i in range(5)]
    df = spark.createDataFrame(rows, "customerID string, tenure int, Churn int, "
                                     "MonthlyCharges double, Contract string")
    scored = df.withColumn("churn_prob", F.lit(0.1))  # nobody at risk
    out = X.strategy_comparison(scored).collect()
    assert all(r.n_at_risk == 0 and r.campaign_cost == 0 and r.roi_pct == 0.0 for r in out)
    scored = df.withColumn("churn_prob", F.lit(0.9))
    prem = X.campaign_roi(scored, "Premium", lifetime=12).first()
    k = math.floor(5 * prem.lift)
    clv = sorted([(100.0 + i) * 12 * 0.25 * 83 for i in range(5)], reverse=True)
    assert prem.saved_n == k and prem.clv_saved == round(sum(clv[:k]), 2)


def test_null_group_dropped_and_grouping_sets_one_shuffle(spark, raw_df_factory):
    from retentio.operators import rates as R
    rows = [raw_row("A", tenure=0, Churn="Yes"), raw_row("B", tenure=5, Churn="No"),
            raw_row("C", tenure=80, Churn="Yes"), raw_row("D", tenure=30, Contract="Two year")]
    feat = FE.add_engagement(FE.add_tenure_group(C.clean_subscribers(raw_df_factory(rows))))
    by = {r.tenure_group: r.customers for r in R.churn_rate_by(feat, "tenure_group").collect()}
    assert None not in by and sum(by.values()) == 2
    flat = spark.createDataFrame(
        [(r.Contract, r.tenure_group, r.Churn) for r in feat.collect()],
        "Contract string, tenure_group string, Churn int")
    gs = R.churn_rate_grouping_sets(flat, ["Contract", "tenure_group"])
    plan = gs._jdf.queryExecution().executedPlan().toString()  # before execution: one plan
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.dimension, r.level): r.customers for r in gs.collect()}
    assert got[("Contract", "Month-to-month")] == 3 and ("tenure_group", None) not in got


def test_levels_are_whole_or_an_error(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y"), (None, "z")], "p string, q string")
    assert FE.categorical_levels(df, ["p", "q"]) == {"p": ["a", "b"], "q": ["x", "y", "z"]}
    assert FE.categorical_levels(df, ["p", "q"], max_levels=5)["q"] == ["x", "y", "z"]
    with pytest.raises(ValueError, match="q has 3 levels"):
        FE.categorical_levels(df, ["p", "q"], max_levels=4)
    assert FE.categorical_levels(df.limit(0), ["p"]) == {"p": []} and FE.categorical_levels(df, []) == {}


def test_correlations_from_level_counts(spark):
    """Equal to numpy on the one-hot columns, with NULL levels, NULL targets, constant columns and lone levels."""
    rows = [("a", "k", 1.0, 1), ("a", "k", 2.0, 0), (None, "k", 4.0, 1), ("b", "k", None, 0), ("b", "k", 8.0, 0),
            ("c", "k", 3.0, None), ("a", "k", 7.0, 1)]
    df = spark.createDataFrame(rows, "p string, q string, v double, Churn int").repartition(3)
    got = {r["feature"]: r["correlation"] for r in target_correlation(df, exclude=()).collect()}
    kept = [r for r in rows if r[3] is not None]
    y = np.array([r[3] for r in kept], float)
    for level in "ab":
        want = np.corrcoef([float(r[0] == level) for r in kept], y)[0, 1]
        assert abs(got[f"p_{level}"] - want) < 1e-6
    both = [(r[2], r[3]) for r in kept if r[2] is not None]
    assert abs(got["v"] - np.corrcoef(np.array(both).T)[0, 1]) < 1e-6
    assert got["p_c"] is None and got["q_k"] is None and set(got) == {"p_a", "p_b", "p_c", "q_k", "v"}
    still = df.withColumn("Churn", F.lit(1))
    assert {r["correlation"] for r in target_correlation(still, exclude=()).collect()} == {None}
    assert target_correlation(df.limit(0), exclude=()).count() == 0
