"""Named queries over the driver's tables.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads the driver's tables
(through the subscriber view), so its work grows with the data.  ``ORACLES``
holds the DuckDB SQL for the same result; queries whose output depends on a
fitted model or a random initialisation have no oracle (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from retentio.operators import clean as C
from retentio.operators import explain as EX
from retentio.operators import features as FE
from retentio.operators import rates as R
from retentio.plans import oracle as O
from retentio.sources.processed import processed
from retentio.sources.subscribers import subscribers_raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's returns BIGINT: cast every call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _bigint_count_if(sql)
        return fn
    return deco


def raw(spark: SparkSession, d: str) -> DataFrame:
    return subscribers_raw(spark, d)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_subscribers(raw(spark, d))


def featured(spark: SparkSession, d: str) -> DataFrame:
    return FE.all_features(cleaned(spark, d))


def clean_table(spark: SparkSession, d: str, refresh: bool = False) -> DataFrame:
    """The processed clean table (S2: built once per source fingerprint, then scanned)."""
    return processed(spark, d, "clean", lambda: cleaned(spark, d), refresh=refresh)


def features_table(spark: SparkSession, d: str, refresh: bool = False) -> DataFrame:
    """The processed feature table (S2), built from the processed clean table."""
    return processed(spark, d, "features", lambda: FE.all_features(clean_table(spark, d)),
                     refresh=refresh)


def base_features(spark: SparkSession, d: str) -> DataFrame:
    """Clean columns plus F1-F3 (tenure_group, engagement_score, charges_per_month)."""
    f = features_table(spark, d)
    keep = [c for c in f.columns if c not in (
        "recency", "frequency", "monetary", "R_Score", "F_Score", "M_Score", "RFM_Score",
        "RFM_Segment")]
    return f.select(*keep)


# ------------------------------------------------------------------ 2.1 / 2.2 scans, cleaning

register("scan_subscribers", O.with_raw("SELECT * FROM subscribers_raw"))(raw)


@register("coerce_numeric", O.with_raw(
    "SELECT customerID, TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges FROM subscribers_raw"))
def q_coerce_numeric(spark, d):
    return C.coerce_numeric_col(raw(spark, d)).select("customerID", "TotalCharges")


@register("dedup_rows", O.with_clean("SELECT * FROM deduped"))
def q_dedup_rows(spark, d):
    return C.dedup_rows(C.coerce_numeric_col(raw(spark, d)))


@register("impute_zero", O.with_clean(
    "SELECT customerID, coalesce(TotalCharges, 0) AS TotalCharges FROM coerced"))
def q_impute_zero(spark, d):
    return C.impute_zero(C.coerce_numeric_col(raw(spark, d))).select("customerID", "TotalCharges")


@register("encode_target", O.with_raw(
    "SELECT customerID, CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS Churn "
    "FROM subscribers_raw"))
def q_encode_target(spark, d):
    return C.encode_target(raw(spark, d)).select("customerID", "Churn")


@register("trim_strings", O.with_raw(
    "SELECT trim(customerID) AS customerID, trim(gender) AS gender, SeniorCitizen, "
    "trim(Partner) AS Partner, trim(Dependents) AS Dependents, tenure, "
    "trim(PhoneService) AS PhoneService, trim(MultipleLines) AS MultipleLines, "
    "trim(InternetService) AS InternetService, trim(OnlineSecurity) AS OnlineSecurity, "
    "trim(OnlineBackup) AS OnlineBackup, trim(DeviceProtection) AS DeviceProtection, "
    "trim(TechSupport) AS TechSupport, trim(StreamingTV) AS StreamingTV, "
    "trim(StreamingMovies) AS StreamingMovies, trim(Contract) AS Contract, "
    "trim(PaperlessBilling) AS PaperlessBilling, trim(PaymentMethod) AS PaymentMethod, "
    "MonthlyCharges, trim(TotalCharges) AS TotalCharges, trim(Churn) AS Churn FROM subscribers_raw"))
def q_trim_strings(spark, d):
    return C.trim_strings(raw(spark, d))


register("clean_subscribers", O.with_clean("SELECT * FROM clean"))(cleaned)


@register("feature_columns", O.with_clean("SELECT * EXCLUDE (customerID, Churn) FROM clean"))
def q_feature_columns(spark, d):
    return C.feature_columns(clean_table(spark, d))


# ------------------------------------------------------------------ 2.3 / 2.5 features, RFM

@register("tenure_groups", O.with_feat("SELECT customerID, tenure, tenure_group FROM f1"))
def q_tenure_groups(spark, d):
    return FE.add_tenure_group(cleaned(spark, d)).select("customerID", "tenure", "tenure_group")


@register("engagement_score", O.with_feat("SELECT customerID, engagement_score FROM f1"))
def q_engagement_score(spark, d):
    return FE.add_engagement(cleaned(spark, d)).select("customerID", "engagement_score")


@register("charges_per_month", O.with_feat("SELECT customerID, charges_per_month FROM f1"))
def q_charges_per_month(spark, d):
    return FE.add_charges_per_month(cleaned(spark, d)).select("customerID", "charges_per_month")


@register("rfm_features", O.with_feat("SELECT customerID, recency, frequency, monetary FROM f2"))
def q_rfm_features(spark, d):
    return (FE.add_rfm_proxies(FE.add_engagement(cleaned(spark, d)))
            .select("customerID", "recency", "frequency", "monetary"))


def _proxies(spark, d):
    return FE.add_rfm_proxies(FE.add_engagement(cleaned(spark, d)))


@register("rfm_r_score", O.with_feat("SELECT customerID, recency, R_Score FROM f4"))
def q_rfm_r_score(spark, d):
    return FE.add_r_score(_proxies(spark, d)).select("customerID", "recency", "R_Score")


@register("rfm_f_score", O.with_feat("SELECT customerID, frequency, F_Score FROM f4"))
def q_rfm_f_score(spark, d):
    return (FE.add_rank_quintile(_proxies(spark, d), "frequency", "F_Score")
            .select("customerID", "frequency", "F_Score"))


@register("rfm_scores", O.with_feat(
    "SELECT customerID, R_Score, F_Score, M_Score, RFM_Score FROM feat"))
def q_rfm_scores(spark, d):
    return featured(spark, d).select("customerID", "R_Score", "F_Score", "M_Score", "RFM_Score")


@register("rfm_segments", O.with_feat("SELECT customerID, RFM_Score, RFM_Segment FROM feat"))
def q_rfm_segments(spark, d):
    return featured(spark, d).select("customerID", "RFM_Score", "RFM_Segment")


register("all_features", O.with_feat("SELECT * FROM feat"))(featured)


# ------------------------------------------------------------------ 2.4 aggregations

@register("kpi_overview", O.with_clean(f"""
SELECT count(*) AS total, CAST(sum(Churn) AS BIGINT) AS churned,
       CAST(count(*) - coalesce(sum(Churn), 0) AS BIGINT) AS retained,
       avg(Churn) AS churn_rate, {O.pct1('sum(Churn)', 'count(Churn)')} AS churn_pct,
       round(avg(MonthlyCharges), 4) AS avg_monthly,
       round(avg(MonthlyCharges) * 83.0, 4) AS avg_monthly_inr, avg(tenure) AS avg_tenure
FROM clean"""))
def q_kpi_overview(spark, d):
    return R.kpi_overview(clean_table(spark, d))


def _rate_sql(dim: str, src: str = "clean") -> str:
    return (f"SELECT {dim}, count(*) AS customers, CAST(sum(Churn) AS BIGINT) AS churned, "
            f"avg(Churn) AS churn_rate, {O.pct1('sum(Churn)', 'count(Churn)')} AS churn_pct "
            f"FROM {src} WHERE {dim} IS NOT NULL GROUP BY {dim}")


for _dim in ["Contract", "InternetService", "PaymentMethod", "SeniorCitizen", "Partner",
             "Dependents"]:
    def _mk(dim):
        def q(spark, d):
            return R.churn_rate_by(clean_table(spark, d), dim)
        return q
    register(f"churn_rate_by_{_dim.lower()}", O.with_clean(_rate_sql(_dim)))(_mk(_dim))

for _dim in ["tenure_group", "engagement_score"]:
    def _mk2(dim):
        def q(spark, d):
            return R.churn_rate_by(base_features(spark, d), dim)
        return q
    register(f"churn_rate_by_{_dim.lower()}", O.with_feat(_rate_sql(_dim, "f1")))(_mk2(_dim))


@register("churn_rate_by_rfm_segment", O.with_feat(_rate_sql("RFM_Segment", "feat")))
def q_churn_rate_by_segment(spark, d):
    return R.churn_rate_by(features_table(spark, d), "RFM_Segment")


_GS_DIMS = ["Contract", "InternetService", "PaymentMethod", "SeniorCitizen", "Partner",
            "Dependents", "tenure_group", "engagement_score"]


def _gs_sql() -> str:
    parts = []
    for dmn in _GS_DIMS:
        parts.append(
            f"SELECT '{dmn}' AS dimension, CAST({dmn} AS VARCHAR) AS level, count(*) AS customers, "
            f"CAST(sum(Churn) AS BIGINT) AS churned, avg(Churn) AS churn_rate, "
            f"{O.pct1('sum(Churn)', 'count(Churn)')} AS churn_pct "
            f"FROM f1 WHERE {dmn} IS NOT NULL GROUP BY {dmn}")
    return O.with_feat("\nUNION ALL\n".join(parts))


@register("churn_rate_grouping_sets", _gs_sql())
def q_grouping_sets(spark, d):
    return R.churn_rate_grouping_sets(base_features(spark, d), _GS_DIMS)


@register("churn_pivot", O.with_clean("""
SELECT InternetService,
  avg(CASE WHEN Contract = 'Month-to-month' THEN Churn END) * 100 AS "Month-to-month",
  avg(CASE WHEN Contract = 'One year' THEN Churn END) * 100 AS "One year",
  avg(CASE WHEN Contract = 'Two year' THEN Churn END) * 100 AS "Two year"
FROM clean WHERE InternetService IS NOT NULL GROUP BY InternetService"""))
def q_churn_pivot(spark, d):
    return R.churn_pivot(clean_table(spark, d))


@register("segment_summary", O.with_feat(f"""
SELECT RFM_Segment, count(customerID) AS Customers, avg(Churn) AS Churn_Rate,
  {O.pct1('sum(Churn)', 'count(Churn)')} AS Churn_pct,
  round(avg(MonthlyCharges), 2) AS Avg_Revenue, avg(tenure) AS Avg_Tenure
FROM feat WHERE RFM_Segment IS NOT NULL GROUP BY RFM_Segment"""))
def q_segment_summary(spark, d):
    return R.segment_summary(features_table(spark, d))


@register("segment_rfm_means", O.with_feat("""
SELECT RFM_Segment, avg(R_Score) AS R_Score, avg(F_Score) AS F_Score, avg(M_Score) AS M_Score
FROM feat WHERE RFM_Segment IS NOT NULL GROUP BY RFM_Segment"""))
def q_segment_rfm_means(spark, d):
    return R.segment_rfm_means(features_table(spark, d))


@register("value_counts", O.with_clean("""
SELECT Contract, count(*) AS count FROM clean WHERE Contract IS NOT NULL GROUP BY Contract"""))
def q_value_counts(spark, d):
    return R.value_counts(clean_table(spark, d), "Contract")


@register("cohort_rates", O.with_feat("""
SELECT avg(CASE WHEN tenure <= 12 THEN Churn END) AS early_churn,
  avg(CASE WHEN tenure >= 36 THEN Churn END) AS mature_churn,
  avg(CASE WHEN TechSupport = 'No' THEN Churn END) AS no_support_churn,
  avg(CASE WHEN TechSupport = 'Yes' THEN Churn END) AS yes_support_churn,
  avg(CASE WHEN engagement_score >= 5 THEN Churn END) AS high_eng_churn,
  avg(CASE WHEN engagement_score <= 2 THEN Churn END) AS low_eng_churn,
  avg(CASE WHEN Contract = 'Month-to-month' THEN Churn END) AS mtm_churn,
  avg(CASE WHEN Contract = 'One year' THEN Churn END) AS one_year_churn,
  avg(CASE WHEN Contract = 'Two year' THEN Churn END) AS two_year_churn,
  avg(CASE WHEN Churn = 1 THEN tenure END) AS churned_avg_tenure,
  avg(CASE WHEN Churn = 0 THEN tenure END) AS retained_avg_tenure,
  count(*) AS customers
FROM f1"""))
def q_cohort_rates(spark, d):
    return R.cohort_rates(base_features(spark, d))


@register("eda_findings", O.with_clean("""
SELECT * FROM (VALUES
  (1, 'Overall churn rate', (SELECT CAST(avg(Churn) AS DOUBLE) FROM clean)),
  (2, 'Month-to-month churn', (SELECT CAST(avg(Churn) AS DOUBLE) FROM clean WHERE Contract = 'Month-to-month')),
  (3, 'Two-year contract churn', (SELECT CAST(avg(Churn) AS DOUBLE) FROM clean WHERE Contract = 'Two year')),
  (4, 'Churners avg tenure', (SELECT CAST(avg(tenure) AS DOUBLE) FROM clean WHERE Churn = 1)),
  (5, 'Retained avg tenure', (SELECT CAST(avg(tenure) AS DOUBLE) FROM clean WHERE Churn = 0)),
  (6, 'Fiber optic churn rate', (SELECT CAST(avg(Churn) AS DOUBLE) FROM clean WHERE InternetService = 'Fiber optic')),
  (7, 'Electronic check churn', (SELECT CAST(avg(Churn) AS DOUBLE) FROM clean WHERE PaymentMethod = 'Electronic check'))
) AS t(pos, finding, value)"""))
def q_eda_findings(spark, d):
    return R.eda_findings(clean_table(spark, d))


@register("best_level", O.with_clean("""
, r AS (SELECT PaymentMethod AS lv, avg(Churn) AS rate FROM clean
        WHERE PaymentMethod IS NOT NULL GROUP BY PaymentMethod)
SELECT (SELECT lv FROM r ORDER BY rate, lv LIMIT 1) AS best_level, min(rate) AS min_rate,
       (SELECT lv FROM r ORDER BY rate DESC, lv LIMIT 1) AS worst_level, max(rate) AS max_rate,
       count(*) AS levels
FROM r""".replace("\n, r AS", ", r AS", 1)))
def q_best_level(spark, d):
    return R.best_level(clean_table(spark, d))


# ------------------------------------------------------------------ 2.4 profiling

from retentio.operators import profile as P  # noqa: E402
from retentio.operators import metrics as M  # noqa: E402
from retentio.operators import model_metrics as MM  # noqa: E402
from retentio.operators import roi as X  # noqa: E402
from retentio.operators import whatif as WI  # noqa: E402
from retentio.operators.scalars import with_scalars

_RAW_ORDER = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
              "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
              "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
              "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
              "MonthlyCharges", "TotalCharges", "Churn"]
_NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn"]
_CATS = [c for c in O._STR_COLS if c != "customerID"]


def coerced(spark, d):
    return C.coerce_numeric_col(raw(spark, d))


@register("null_counts", O.with_clean("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS pos, '{c}' AS \"column\", count_if({c} IS NULL) AS null_count FROM coerced"
    for i, c in enumerate(_RAW_ORDER))))
def q_null_counts(spark, d):
    return P.null_counts(coerced(spark, d))


@register("duplicate_count", O.with_clean("""
SELECT (SELECT count(*) FROM coerced) AS "rows", (SELECT count(*) FROM deduped) AS distinct_rows,
       (SELECT count(*) FROM coerced) - (SELECT count(*) FROM deduped) AS duplicates"""))
def q_duplicate_count(spark, d):
    return P.duplicate_count(coerced(spark, d))


@register("distinct_counts", O.with_clean("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS pos, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM clean"
    for i, c in enumerate(_RAW_ORDER))))
def q_distinct_counts(spark, d):
    return P.distinct_counts(clean_table(spark, d))


_TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double", "TotalCharges": "double", "Churn": "int"}


@register("data_dictionary", O.with_clean("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS pos, '{c}' AS \"column\", '{_TYPES.get(c, 'string')}' AS dtype, count(DISTINCT {c}) AS distinct_count, "
    f"arg_min(CAST({c} AS VARCHAR), customerID) AS sample FROM clean" for i, c in enumerate(_RAW_ORDER))))
def q_data_dictionary(spark, d):
    return P.data_dictionary(clean_table(spark, d))


@register("describe_numeric", O.with_clean("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS pos, '{c}' AS \"column\", count({c}) AS count, "
    f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
    f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, "
    f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM clean"
    for i, c in enumerate(_NUMERIC))))
def q_describe_numeric(spark, d):
    return P.describe_numeric(clean_table(spark, d), _NUMERIC)


_HIST_CTE = """,
rng AS (SELECT CAST(min(tenure) AS DOUBLE) AS lo, CAST(max(tenure) AS DOUBLE) AS hi
        FROM clean WHERE tenure IS NOT NULL),
hb AS (SELECT Churn, lo, hi,
         CAST(CASE WHEN hi > lo THEN least(CAST(floor((CAST(tenure AS DOUBLE) - lo) / (hi - lo) * 30) AS BIGINT) + 1, 30)
                   ELSE 1 END AS BIGINT) AS bin
       FROM clean, rng WHERE tenure IS NOT NULL),
hist AS (SELECT Churn, bin, count(*) AS count, first(lo + (bin - 1) * ((hi - lo) / 30)) AS bin_lo,
                first(lo + bin * ((hi - lo) / 30)) AS bin_hi
         FROM hb GROUP BY Churn, bin)"""


@register("histogram", O.with_clean(_HIST_CTE + "\nSELECT * FROM hist"))
def q_histogram(spark, d):
    return P.histogram(clean_table(spark, d), "tenure", 30, by="Churn")


@register("class_density", O.with_clean(_HIST_CTE + """
SELECT Churn, bin, count, CAST(count AS DOUBLE) / CAST(sum(count) OVER (PARTITION BY Churn) AS DOUBLE) AS share
FROM hist"""))
def q_class_density(spark, d):
    return P.class_density(clean_table(spark, d), "tenure", "Churn", 30)


@register("box_stats", O.with_clean("""
, q AS (SELECT Churn, quantile_cont(MonthlyCharges, 0.25) AS q1, quantile_cont(MonthlyCharges, 0.5) AS median,
              quantile_cont(MonthlyCharges, 0.75) AS q3, count(MonthlyCharges) AS n
       FROM clean WHERE Churn IS NOT NULL AND MonthlyCharges IS NOT NULL GROUP BY Churn),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
bx AS (SELECT f.Churn, f.q1, f.median, f.q3, f.n, f.iqr, f.lower_fence, f.upper_fence,
  min(CASE WHEN c.MonthlyCharges >= lower_fence AND c.MonthlyCharges <= upper_fence THEN c.MonthlyCharges END) AS whisker_low,
  max(CASE WHEN c.MonthlyCharges >= lower_fence AND c.MonthlyCharges <= upper_fence THEN c.MonthlyCharges END) AS whisker_high,
  count_if(NOT (c.MonthlyCharges >= lower_fence AND c.MonthlyCharges <= upper_fence)) AS outliers
FROM f JOIN clean c ON c.Churn = f.Churn
GROUP BY ALL)
SELECT Churn, n, outliers, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(iqr, 4) AS iqr, round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence,
  round(whisker_low, 4) AS whisker_low, round(whisker_high, 4) AS whisker_high FROM bx""".replace("\n, q AS", ", q AS", 1)))
def q_box_stats(spark, d):
    return P.box_stats(clean_table(spark, d), "MonthlyCharges", "Churn")


def _corr_sql() -> str:
    parts = [f"SELECT Churn, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM clean"
             for c in ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]]
    for c in _CATS:
        parts.append(
            f"SELECT s.Churn, '{c}_' || l.v AS feature, CAST(coalesce(s.{c} = l.v, false) AS DOUBLE) AS x "
            f"FROM clean s, (SELECT DISTINCT {c} AS v FROM clean WHERE {c} IS NOT NULL) l")
    return (", enc AS (" + "\nUNION ALL\n".join(parts) + "),\n"
            "cr AS (SELECT feature, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(Churn) > 0 "
            "THEN corr(x, Churn) END, 6) AS correlation FROM enc WHERE Churn IS NOT NULL GROUP BY feature)")


@register("target_correlation", O.with_clean(_corr_sql() + "\nSELECT * FROM cr"))
def q_target_correlation(spark, d):
    return P.target_correlation(clean_table(spark, d))


@register("top_correlations", O.with_clean(_corr_sql() + """
SELECT * FROM (
  SELECT 'positive' AS direction, CAST(row_number() OVER (ORDER BY correlation DESC, feature) AS INTEGER) AS rank, feature, correlation
  FROM cr WHERE correlation IS NOT NULL) WHERE rank <= 5
UNION ALL
SELECT * FROM (
  SELECT 'negative' AS direction, CAST(row_number() OVER (ORDER BY correlation ASC, feature) AS INTEGER) AS rank, feature, correlation
  FROM cr WHERE correlation IS NOT NULL) WHERE rank <= 5"""))
def q_top_correlations(spark, d):
    return P.top_correlations(clean_table(spark, d), 5)


# ------------------------------------------------------------------ 2.8 metrics on the X2 score

def scored_heuristic(spark, d) -> DataFrame:
    """Clean table with the X2 heuristic score as (label, score)."""
    s = X.with_heuristic_score(clean_table(spark, d), out="score")
    return s.select("customerID", F.col("Churn").alias("label"), "tenure", "MonthlyCharges", "score")


@register("heuristic_score", O.with_scored("SELECT customerID, score AS churn_prob FROM scored"))
def q_heuristic_score(spark, d):
    return X.with_heuristic_score(clean_table(spark, d)).select("customerID", "churn_prob")


@register("risk_tiers", O.with_scored("""
SELECT customerID, score AS churn_prob,
  CASE WHEN score >= 0.65 THEN 'HIGH RISK' WHEN score >= 0.35 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_tier
FROM scored"""))
def q_risk_tiers(spark, d):
    return X.risk_tiers(X.with_heuristic_score(clean_table(spark, d))).select(
        "customerID", "churn_prob", "risk_tier")


@register("at_risk", O.with_scored("SELECT customerID, score AS churn_prob FROM scored WHERE score >= 0.5"))
def q_at_risk(spark, d):
    return C.at_risk(X.with_heuristic_score(clean_table(spark, d)), "churn_prob", 0.5).select(
        "customerID", "churn_prob")


@register("roc_curve", O.with_cum(f"""
SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp,
       CAST(0.0 AS DOUBLE) AS tpr, CAST(0.0 AS DOUBLE) AS fpr
UNION ALL
SELECT threshold, cum_tp, cum_fp, {O.sdiv('cum_tp', 'all_tp')}, {O.sdiv('cum_fp', 'all_fp')} FROM cum"""))
def q_roc_curve(spark, d):
    return M.roc_curve(scored_heuristic(spark, d))


@register("auc_roc", O.with_cum("""
SELECT CASE WHEN max(all_tp) * max(all_fp) > 0 THEN
  CAST(sum(CAST(neg AS HUGEINT) * (2 * cum_tp - pos)) AS DOUBLE) / CAST(2 * max(all_tp) * max(all_fp) AS DOUBLE) END AS auc,
  max(all_tp) AS positives, max(all_fp) AS negatives FROM cum"""))
def q_auc_roc(spark, d):
    return M.auc_roc(scored_heuristic(spark, d))


@register("pr_curve", O.with_cum(f"""
SELECT threshold, {O.sdiv('cum_tp', 'cum_tp + cum_fp')} AS precision, {O.sdiv('cum_tp', 'all_tp')} AS recall FROM cum
UNION ALL SELECT CAST('Infinity' AS DOUBLE), 1.0, 0.0"""))
def q_pr_curve(spark, d):
    return M.pr_curve(scored_heuristic(spark, d))


@register("avg_precision", O.with_cum(f"""
SELECT round(sum({O.sdiv('pos', 'all_tp')} * {O.sdiv('cum_tp', 'cum_tp + cum_fp')}), 10) AS avg_precision FROM cum"""))
def q_avg_precision(spark, d):
    return M.avg_precision(scored_heuristic(spark, d))


_CNT = """, cnt AS (SELECT count_if(label = 1 AND score >= {t}) AS tp, count_if(label = 0 AND score >= {t}) AS fp,
  count_if(label = 1 AND NOT score >= {t}) AS fn, count_if(label = 0 AND NOT score >= {t}) AS tn
  FROM scored WHERE label IS NOT NULL)"""


def _report(prefix: str = "") -> str:
    return (f"{O.sdiv('tp', 'tp + fp')} AS precision, {O.sdiv('tp', 'tp + fn')} AS recall, "
            f"{O.sdiv('2 * tp', '2 * tp + fp + fn')} AS f1")


@register("confusion_matrix", O.with_scored(_CNT.format(t="0.5") + """
SELECT 1 AS actual, 1 AS predicted, tp AS count FROM cnt UNION ALL SELECT 0, 1, fp FROM cnt
UNION ALL SELECT 1, 0, fn FROM cnt UNION ALL SELECT 0, 0, tn FROM cnt"""))
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(scored_heuristic(spark, d), 0.5)


@register("classification_report", O.with_scored(_CNT.format(t="0.5") + f"""
SELECT tp, fp, fn, tn, {O.sdiv('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_report()} FROM cnt"""))
def q_classification_report(spark, d):
    return M.classification_report(scored_heuristic(spark, d), 0.5)


@register("threshold_metrics", O.with_scored(_CNT.format(t="0.5") + f"""
SELECT CAST(0.5 AS DOUBLE) AS threshold, {_report()}, tp + fp AS flagged, tp + fp + fn + tn AS total FROM cnt"""))
def q_threshold_metrics(spark, d):
    return M.threshold_metrics(scored_heuristic(spark, d), 0.5)


@register("threshold_sweep", O.with_scored(""",
ts AS (SELECT i / 100 AS t FROM range(10, 91, 5) r(i)),
cnt AS (SELECT t, count_if(label = 1 AND score >= t) AS tp, count_if(label = 0 AND score >= t) AS fp,
  count_if(label = 1 AND NOT score >= t) AS fn, count_if(label = 0 AND NOT score >= t) AS tn
  FROM ts, scored WHERE label IS NOT NULL GROUP BY t)
SELECT t AS threshold, """ + _report() + """, tp + fp AS flagged, tp + fp + fn + tn AS total FROM cnt"""
.replace("\n,\nts AS", ", ts AS", 1).replace(",\nts AS", ", ts AS", 1)))
def q_threshold_sweep(spark, d):
    return M.threshold_sweep(scored_heuristic(spark, d))


#: Six fixed scores of a row, each as SQL and as a Spark expression: curves of several models without a fitted one.
FROZEN_SCORES = {
    "tenure": ("score", lambda: F.col("score")),
    "constant": ("CAST(0.5 AS DOUBLE)", lambda: F.lit(0.5)),
    "charges": ("CAST(MonthlyCharges AS DOUBLE) / CAST(1000000 AS DOUBLE)", lambda: F.col("MonthlyCharges").cast("double") / F.lit(1000000.0)),
    "reverse": ("CAST(tenure AS DOUBLE) / CAST(1000 AS DOUBLE)", lambda: F.col("tenure").cast("double") / F.lit(1000.0)),
    "coarse": ("floor(score * CAST(5 AS DOUBLE)) / CAST(5 AS DOUBLE)", lambda: F.floor(F.col("score") * F.lit(5.0)) / F.lit(5.0)),
    "partial": ("CASE WHEN tenure > 6 THEN score END", lambda: F.when(F.col("tenure") > 6, F.col("score"))),
}
_FROZEN_CTE = ", scores AS (" + " UNION ALL ".join(
    f"SELECT customerID, label, '{n}' AS model, {sql} AS score FROM scored" for n, (sql, _) in FROZEN_SCORES.items()) + """),
sm AS (SELECT model, score AS threshold, count_if(label = 1) AS pos, count_if(label = 0) AS neg
  FROM scores WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_tp, CAST(sum(neg) OVER w AS BIGINT) AS cum_fp,
  CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS all_tp, CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS all_fp
  FROM sm WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""


def frozen_scores(spark, d) -> DataFrame:
    return MM.long_scores(scored_heuristic(spark, d), {n: made() for n, (_, made) in FROZEN_SCORES.items()}, "label", ("customerID",))


@register("frozen_roc_curves", O.with_scored(_FROZEN_CTE + f"""
SELECT DISTINCT model, CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp,
  CAST(0.0 AS DOUBLE) AS tpr, CAST(0.0 AS DOUBLE) AS fpr FROM cum
UNION ALL
SELECT model, threshold, cum_tp, cum_fp, {O.sdiv('cum_tp', 'all_tp')}, {O.sdiv('cum_fp', 'all_fp')} FROM cum"""))
def q_frozen_roc_curves(spark, d):
    """M9 of six scores at once, from one sort."""
    return MM.roc_curves(MM.cumulated(frozen_scores(spark, d)))


@register("frozen_pr_curves", O.with_scored(_FROZEN_CTE + f"""
SELECT model, threshold, {O.sdiv('cum_tp', 'cum_tp + cum_fp')} AS precision, {O.sdiv('cum_tp', 'all_tp')} AS recall FROM cum
UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 1.0, 0.0 FROM cum"""))
def q_frozen_pr_curves(spark, d):
    """M10 of six scores at once."""
    return MM.pr_curves(MM.cumulated(frozen_scores(spark, d)))


_FROZEN_REPORT = _FROZEN_CTE + f""", one AS (
SELECT model, CASE WHEN max(all_tp) * max(all_fp) > 0 THEN CAST(sum(CAST(neg AS HUGEINT) * (2 * cum_tp - pos)) AS DOUBLE)
    / CAST(2 * max(all_tp) * max(all_fp) AS DOUBLE) END AS auc,
  round(sum({O.sdiv('pos', 'all_tp')} * {O.sdiv('cum_tp', 'cum_tp + cum_fp')}), 10) AS avg_precision,
  CAST(coalesce(sum(CASE WHEN threshold >= 0.5 THEN pos END), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(CASE WHEN threshold >= 0.5 THEN neg END), 0) AS BIGINT) AS fp, max(all_tp) AS p, max(all_fp) AS n
FROM cum GROUP BY model), cnt AS (SELECT *, p - tp AS fn, n - fp AS tn FROM one),
report AS (SELECT model, auc, avg_precision, tp, fp, fn, tn, {O.sdiv('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_report()} FROM cnt),
comparison AS (SELECT model, round(auc, 4) AS auc_roc, round(avg_precision, 4) AS avg_precision, round(accuracy, 4) AS accuracy,
  round(precision, 4) AS precision_churn, round(recall, 4) AS recall_churn, round(f1, 4) AS f1_churn FROM report)
"""


@register("frozen_summaries", O.with_scored(_FROZEN_REPORT + "SELECT * FROM report"))
def q_frozen_summaries(spark, d):
    """M9, M10, M12 and M15 of six scores at once."""
    return MM.summaries(MM.cumulated(frozen_scores(spark, d)))


@register("frozen_threshold_sweeps", O.with_scored(_FROZEN_CTE + """, ts AS (SELECT i / 100 AS t FROM range(10, 91, 5) r(i)),
cnt AS (SELECT model, t, count_if(label = 1 AND score >= t) AS tp, count_if(label = 0 AND score >= t) AS fp,
  count_if(label = 1 AND NOT score >= t) AS fn, count_if(label = 0 AND NOT score >= t) AS tn
  FROM ts, scores WHERE label IS NOT NULL GROUP BY model, t)
SELECT model, t AS threshold, """ + _report() + """, tp + fp AS flagged, tp + fp + fn + tn AS total FROM cnt"""))
def q_frozen_threshold_sweeps(spark, d):
    """M14 of six scores in one pass."""
    return MM.threshold_sweeps(frozen_scores(spark, d))


@register("frozen_confusion", O.with_scored(_FROZEN_CTE + """, cnt AS (SELECT model, count_if(label = 1 AND score >= 0.5) AS tp,
  count_if(label = 0 AND score >= 0.5) AS fp, count_if(label = 1 AND NOT score >= 0.5) AS fn, count_if(label = 0 AND NOT score >= 0.5) AS tn
  FROM scores WHERE label IS NOT NULL GROUP BY model)
SELECT model, 1 AS actual, 1 AS predicted, tp AS count FROM cnt UNION ALL SELECT model, 0, 1, fp FROM cnt
UNION ALL SELECT model, 1, 0, fn FROM cnt UNION ALL SELECT model, 0, 0, tn FROM cnt"""))
def q_frozen_confusion(spark, d):
    """M11 of six scores in one pass."""
    return MM.confusion_matrices(frozen_scores(spark, d))


# ------------------------------------------------------------------ 2.10 ROI, CLV, actions

_LIFE_COLS = ["lift_premium", "lift_standard", "lift_basic", "lift_minimal", "base_churn",
              "implied_lifetime"]


@register("lift_rates", O.with_life("SELECT * FROM life"))
def q_lift_rates(spark, d):
    return X.lift_rates(clean_table(spark, d))


@register("implied_lifetime", O.with_life("SELECT base_churn, implied_lifetime FROM life"))
def q_implied_lifetime(spark, d):
    return X.lift_rates(clean_table(spark, d)).select("base_churn", "implied_lifetime")


@register("clv_variants", O.with_life(""",
cl AS (SELECT customerID,
  MonthlyCharges * tenure * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS clv_lookup,
  MonthlyCharges * greatest(tenure, 1) * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS clv_simulator,
  MonthlyCharges * implied_lifetime * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS clv_roi
  FROM clean, life)
SELECT * FROM cl""".replace("\n,\ncl AS", ", cl AS", 1).replace(",\ncl AS", ", cl AS", 1)))
def q_clv_variants(spark, d):
    c = clean_table(spark, d)
    life = X.lift_rates(c).select("implied_lifetime")
    return (X.clv_variants(with_scalars(c, life), lifetime=F.col("implied_lifetime"))
            .select("customerID", "clv_lookup", "clv_simulator", "clv_roi"))


_PROF = X.PROFILES["orders"]


@register("retention_action", O.with_scored(f""",
a AS (SELECT customerID, score AS churn_prob,
  MonthlyCharges * tenure * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS clv FROM scored)
SELECT customerID, churn_prob, clv,
  CASE WHEN churn_prob >= 0.65 AND clv >= {_PROF['clv_high']} THEN 'Personal Manager + 20% Discount'
       WHEN churn_prob >= 0.65 THEN 'Targeted 15% Discount'
       WHEN churn_prob >= 0.35 AND clv >= {_PROF['clv_mid']} THEN 'Loyalty Rewards + Upgrade Offer'
       WHEN churn_prob >= 0.35 THEN 'Automated Re-engagement'
       ELSE 'Monitor — Low Risk' END AS action,
  CASE WHEN churn_prob >= 0.65 AND clv >= {_PROF['clv_high']} THEN 500
       WHEN churn_prob >= 0.65 THEN 200
       WHEN churn_prob >= 0.35 AND clv >= {_PROF['clv_mid']} THEN 300
       WHEN churn_prob >= 0.35 THEN 50 ELSE 10 END AS action_cost,
  CASE WHEN churn_prob >= 0.65 AND clv >= {_PROF['clv_high']} THEN 'Immediate personal outreach. High-value at critical risk.'
       WHEN churn_prob >= 0.65 THEN 'Send personalised discount via email/SMS within 24h.'
       WHEN churn_prob >= 0.35 AND clv >= {_PROF['clv_mid']} THEN 'Reward tenure with a free service upgrade for 3 months.'
       WHEN churn_prob >= 0.35 THEN 'Email + push notification nurture sequence.'
       ELSE 'Continue standard experience. Review in 3 months.' END AS reason,
  CASE WHEN churn_prob >= 0.65 AND clv >= {_PROF['clv_high']} THEN 40
       WHEN churn_prob >= 0.65 THEN 30
       WHEN churn_prob >= 0.35 AND clv >= {_PROF['clv_mid']} THEN 20
       WHEN churn_prob >= 0.35 THEN 15 ELSE 5 END AS action_lift_pct
FROM a""".replace("\n,\na AS", ", a AS", 1).replace(",\na AS", ", a AS", 1)))
def q_retention_action(spark, d):
    s = X.with_heuristic_score(clean_table(spark, d))
    return X.retention_actions(s).select("customerID", "churn_prob", "clv", "action", "action_cost",
                                           "reason", "action_lift_pct")


def _strategy_sql() -> str:
    parts = []
    for i, (name, lift, cost) in enumerate(X.STRATEGIES):
        sv = f"(CASE WHEN floor(coalesce(n, 0) * {lift}) > 0 THEN coalesce(sv_{name}, 0.0) ELSE 0.0 END)"
        cc = f"CAST(coalesce(n, 0) * {cost} AS BIGINT)"
        parts.append(
            f"SELECT {i + 1} AS pos, '{name}' AS strategy, {lift} AS lift, {cost} AS cost_per_customer, "
            f"CAST(coalesce(n, 0) AS BIGINT) AS n_at_risk, "
            f"CASE WHEN customers > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / customers END AS share_of_base, "
            f"round(coalesce(clv_at_risk, 0.0), 2) AS clv_at_risk, {cc} AS campaign_cost, "
            f"CAST(floor(coalesce(n, 0) * {lift}) AS BIGINT) AS saved_n, round({sv}, 2) AS clv_saved, "
            f"round({sv} - {cc}, 2) AS net, "
            f"round(CASE WHEN {cc} > 0 THEN ({sv} - {cc}) / {cc} * 100 ELSE 0.0 END, 4) AS roi_pct "
            f"FROM agg, life, (SELECT count(*) AS customers FROM clean)")
    sums = ", ".join(
        f"sum(CASE WHEN clv_rank <= floor(n_at_risk * {lift}) THEN CLV END) AS sv_{name}"
        for name, lift, _ in X.STRATEGIES)
    return O.with_life(f""", sc AS (SELECT customerID, MonthlyCharges,
      (1.0 - tenure / max(tenure) OVER ()) * CAST(0.6 AS DOUBLE) AS churn_prob FROM clean),
atr AS (SELECT customerID, MonthlyCharges * implied_lifetime * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS CLV
        FROM sc, life WHERE churn_prob >= 0.5),
rk AS (SELECT *, row_number() OVER (ORDER BY CLV DESC, customerID) AS clv_rank,
              count(*) OVER () AS n_at_risk FROM atr),
agg AS (SELECT count(*) AS n, sum(CLV) AS clv_at_risk, {sums} FROM rk, life),
cmp AS ({' UNION ALL '.join(parts)})
""")


_STRAT = _strategy_sql()


@register("strategy_comparison", _STRAT + "SELECT * FROM cmp")
def q_strategy_comparison(spark, d):
    return X.strategy_comparison(X.with_heuristic_score(clean_table(spark, d)))


@register("campaign_roi", _STRAT + "SELECT * EXCLUDE (pos) FROM cmp WHERE strategy = 'Premium'")
def q_campaign_roi(spark, d):
    return X.campaign_roi(X.with_heuristic_score(clean_table(spark, d)), "Premium")


@register("top_clv_saved", _STRAT + "SELECT saved_n, clv_saved FROM cmp WHERE strategy = 'Premium'")
def q_top_clv_saved(spark, d):
    return X.top_clv_saved(X.with_heuristic_score(clean_table(spark, d)), "Premium")


@register("roi_waterfall", _STRAT + """
SELECT 1 AS pos, 'Revenue Saved' AS step, clv_saved AS value, roi_pct FROM cmp WHERE strategy = 'Premium'
UNION ALL SELECT 2, 'Campaign Cost', CAST(-campaign_cost AS DOUBLE), roi_pct FROM cmp WHERE strategy = 'Premium'
UNION ALL SELECT 3, 'Net', net, roi_pct FROM cmp WHERE strategy = 'Premium'
""".replace("roi_pct FROM", "CASE WHEN roi_pct > 100 THEN 'strong' WHEN roi_pct > 0 THEN 'positive' "
            "ELSE 'negative' END AS roi_band FROM"))
def q_roi_waterfall(spark, d):
    return X.roi_waterfall(X.with_heuristic_score(clean_table(spark, d)), "Premium")


@register("contract_lift", O.with_clean("""
, r AS (SELECT Contract, avg(Churn) AS churn_rate FROM clean WHERE Contract IS NOT NULL GROUP BY Contract)
SELECT r.Contract, r.churn_rate, b.churn_rate - r.churn_rate AS lift_vs_baseline
FROM r, (SELECT churn_rate FROM r WHERE Contract = 'Month-to-month') b""".replace("\n, r AS", ", r AS", 1)))
def q_contract_lift(spark, d):
    return X.contract_lift(clean_table(spark, d))


@register("clv_distribution", O.with_life(""", sc AS (SELECT MonthlyCharges,
      (1.0 - tenure / max(tenure) OVER ()) * CAST(0.6 AS DOUBLE) AS churn_prob FROM clean),
atr AS (SELECT MonthlyCharges * implied_lifetime * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS CLV
        FROM sc, life WHERE churn_prob >= 0.5)
SELECT count(*) AS n_at_risk, round(avg(CLV), 2) AS clv_mean, round(quantile_cont(CLV, 0.75), 2) AS clv_p75
FROM atr"""))
def q_clv_distribution(spark, d):
    return X.clv_distribution(X.with_heuristic_score(clean_table(spark, d)))


# ------------------------------------------------------------------ what-if, risk factors

def _profiles(spark, d):
    """Clean columns plus engagement_score and charges_per_month (the simulator's profile)."""
    return base_features(spark, d).drop("tenure_group")


def _factor_sql() -> str:
    fb = WI.FALLBACKS
    st = ",\n".join(
        f"coalesce(avg(CASE WHEN {cond} THEN Churn END), {fb[k]}) AS {k}" for k, cond in [
            ("early_churn", "tenure <= 12"), ("mature_churn", "tenure >= 36"),
            ("no_support_churn", "TechSupport = 'No'"), ("yes_support_churn", "TechSupport = 'Yes'"),
            ("high_eng_churn", "engagement_score >= 5"), ("low_eng_churn", "engagement_score <= 2"),
            ("mtm_churn", "Contract = 'Month-to-month'"), ("one_year_churn", "Contract = 'One year'"),
            ("two_year_churn", "Contract = 'Two year'")])
    rules = [
        (1, "'Month-to-Month Contract'", "neg", "mtm_churn", "Contract = 'Month-to-month' AND has_contract"),
        (1, "'Two-Year Contract'", "pos", "two_year_churn", "Contract = 'Two year'"),
        (1, "'One-Year Contract'", "neu", "one_year_churn", "Contract = 'One year'"),
        (2, "'New Customer (≤12 months)'", "neg", "early_churn", "tenure <= 12"),
        (2, "'Long-Tenure Customer (36+ months)'", "pos", "mature_churn", "tenure >= 36"),
        (3, "'No Tech Support'", "neg", "no_support_churn", "TechSupport = 'No' AND InternetService <> 'No'"),
        (3, "'Tech Support Active'", "pos", "yes_support_churn", "TechSupport = 'Yes'"),
        (4, "PaymentMethod", "neg", "pay_rate", "pay_rate IS NOT NULL AND pay_rate >= max_pay * 0.9"),
        (4, "PaymentMethod", "pos", "pay_rate",
         "pay_rate IS NOT NULL AND NOT (pay_rate >= max_pay * 0.9) AND pay_rate <= min_pay * 1.2"),
        (5, "'High Engagement (' || engagement_score || '/8 services)'", "pos", "high_eng_churn",
         "engagement_score >= 5"),
        (5, "'Low Engagement (' || engagement_score || '/8 services)'", "neg", "low_eng_churn",
         "engagement_score <= 2"),
        (6, "InternetService || ' Internet'", "neg", "int_rate",
         "int_rate IS NOT NULL AND int_rate >= max_int * 0.9"),
        (8, "'Senior Citizen'", "neg", "NULL", "SeniorCitizen = 1"),
    ]
    said = ["mtm", "two_year", "one_year", "early", "mature", "no_support", "support", "pay_max", "pay_min",
            "high_eng", "low_eng", "net", "senior"]
    versus = {"mtm": "two_year_churn", "early": "mature_churn", "no_support": "yes_support_churn",
              "support": "no_support_churn", "high_eng": "low_eng_churn"}

    def percent(x: str) -> str:
        return f"printf('%.1f%%', CAST({x} AS DOUBLE) * 100)"

    def desc(name: str, rate: str) -> str:
        text = f"'{WI.DESCRIPTIONS[name]}'"
        text = f"replace({text}, '{{r}}', {percent(rate)})" if "{r}" in text else text
        return f"replace({text}, '{{v}}', {percent(versus[name])})" if "{v}" in text else text

    sel = "\nUNION ALL\n".join(
        f"SELECT customerID, {p} AS pos, {lab} AS factor, '{k}' AS kind, CAST({rate} AS DOUBLE) AS rate, "
        f"CAST({versus.get(name, 'NULL')} AS DOUBLE) AS versus, {desc(name, rate)} AS \"desc\", "
        f"{'false' if p == 8 else 'true'} AS from_data FROM j WHERE {cond}"
        for (p, lab, k, rate, cond), name in zip(rules, said))
    return O.with_feat(f""", st AS (SELECT {st},
  count(CASE WHEN Contract IS NOT NULL THEN 1 END) > 0 AS has_contract FROM f1),
pay AS (SELECT PaymentMethod, avg(Churn) AS pay_rate FROM f1 WHERE PaymentMethod IS NOT NULL GROUP BY 1),
net AS (SELECT InternetService, avg(Churn) AS int_rate FROM f1 WHERE InternetService IS NOT NULL GROUP BY 1),
mm AS (SELECT (SELECT max(pay_rate) FROM pay) AS max_pay, (SELECT min(pay_rate) FROM pay) AS min_pay,
              (SELECT max(int_rate) FROM net) AS max_int),
j AS (SELECT f1.*, pay.pay_rate, net.int_rate, st.*, mm.*
      FROM f1 LEFT JOIN pay ON f1.PaymentMethod = pay.PaymentMethod
      LEFT JOIN net ON f1.InternetService = net.InternetService, st, mm)
{sel}""")


@register("risk_factors", _factor_sql())
def q_risk_factors(spark, d):
    p = _profiles(spark, d)
    return WI.risk_factors(p, p)


def heuristic_scorer(population: DataFrame, prob: str = "churn_prob"):
    """X2 as a scorer with the population's max tenure frozen."""
    mx = population.agg(F.max("tenure").alias("_mx"))

    def score(rows: DataFrame) -> DataFrame:
        from retentio.functions.expr import heuristic_score
        return (with_scalars(rows, mx)
                .withColumn(prob, heuristic_score("tenure", "_mx")).drop("_mx"))
    return score


def _scenario_sql() -> str:
    vals = ", ".join(f"({i}, '{n}')" for i, n in WI.SCENARIOS)
    eng = O._ENG
    return O.with_clean(f""", prof AS (SELECT *, {eng} AS engagement_score,
    CASE WHEN tenure > 0 THEN TotalCharges / tenure ELSE MonthlyCharges END AS charges_per_month FROM clean),
pm AS (SELECT max(tenure) AS mx,
         (SELECT PaymentMethod FROM (SELECT PaymentMethod, avg(Churn) AS rate FROM prof
           WHERE PaymentMethod IS NOT NULL GROUP BY 1) ORDER BY rate, PaymentMethod LIMIT 1) AS best_pay
       FROM prof),
scn AS (SELECT * FROM (VALUES {vals}) t(scenario_id, scenario)),
x AS (SELECT prof.*, scn.scenario_id, scn.scenario, pm.best_pay, pm.mx,
             (1.0 - prof.tenure / pm.mx) * CAST(0.6 AS DOUBLE) AS base
      FROM prof, scn, pm
      WHERE scenario_id IN (0, 5) OR (scenario_id = 1 AND Contract <> 'Two year')
         OR (scenario_id = 2 AND TechSupport = 'No' AND InternetService <> 'No')
         OR (scenario_id = 3 AND best_pay IS NOT NULL AND best_pay <> PaymentMethod)
         OR (scenario_id = 4 AND tenure < 60)),
y AS (SELECT customerID, gender, SeniorCitizen, Partner, Dependents,
    CASE WHEN scenario_id = 4 THEN tenure + 12 ELSE tenure END AS tenure,
    PhoneService, MultipleLines, InternetService,
    CASE WHEN scenario_id = 5 THEN 'Yes' ELSE OnlineSecurity END AS OnlineSecurity,
    CASE WHEN scenario_id = 5 THEN 'Yes' ELSE OnlineBackup END AS OnlineBackup,
    CASE WHEN scenario_id = 5 THEN 'Yes' ELSE DeviceProtection END AS DeviceProtection,
    CASE WHEN scenario_id IN (2, 5) THEN 'Yes' ELSE TechSupport END AS TechSupport,
    StreamingTV, StreamingMovies,
    CASE WHEN scenario_id = 1 THEN 'Two year' ELSE Contract END AS Contract, PaperlessBilling,
    CASE WHEN scenario_id = 3 THEN best_pay ELSE PaymentMethod END AS PaymentMethod, MonthlyCharges,
    CASE WHEN scenario_id = 4 THEN (tenure + 12) * MonthlyCharges ELSE TotalCharges END AS TotalCharges,
    Churn, scenario_id,
    CASE WHEN scenario_id = 3 THEN 'Switch to ' || best_pay ELSE scenario END AS scenario, base, mx FROM x)
SELECT y.* EXCLUDE (base, mx), {eng} AS engagement_score,
  CASE WHEN tenure > 0 THEN TotalCharges / tenure ELSE MonthlyCharges END AS charges_per_month,
  (1.0 - tenure / mx) * CAST(0.6 AS DOUBLE) AS churn_prob,
  (1.0 - tenure / mx) * CAST(0.6 AS DOUBLE) - base AS delta
FROM y""")


@register("whatif_scenarios", _scenario_sql())
def q_whatif_scenarios(spark, d):
    p = _profiles(spark, d)
    return WI.whatif_scenarios(p, p, heuristic_scorer(p))


# ------------------------------------------------------------------ lookups, transposes, encodings

_LOOKUP_Q = """q AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0
      THEN upper('cust-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'))
      ELSE right(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 5) END AS query FROM customer)"""


def lookup_queries(spark, d) -> DataFrame:
    """Search strings derived from every customer key: exact ids for even keys
    (upper-cased), 5-digit fragments for odd keys (exercise the contains path)."""
    from retentio.sources.tables import read_table
    k = F.col("c_custkey")
    padded = F.lpad(k.cast("string"), 8, "0")
    return read_table(spark, d, "customer", ["c_custkey"]).select(
        F.when(k % 2 == 0, F.upper(F.concat(F.lit("cust-"), padded)))
        .otherwise(F.substring(padded, 4, 5)).alias("query"))


@register("lookup_customer", O.with_clean(f""", {_LOOKUP_Q},
ex AS (SELECT q.query, min(s.customerID) AS customerID FROM q JOIN clean s
       ON lower(trim(q.query)) = lower(s.customerID) GROUP BY q.query),
rest AS (SELECT query FROM q WHERE query NOT IN (SELECT query FROM ex)),
ct AS (SELECT r.query, min(s.customerID) AS customerID FROM rest r JOIN clean s
       ON contains(lower(s.customerID), lower(trim(r.query))) GROUP BY r.query)
SELECT query, customerID, 'exact' AS match_type FROM ex
UNION ALL SELECT query, customerID, 'contains' AS match_type FROM ct"""))
def q_lookup_customer(spark, d):
    return C.lookup_customer(clean_table(spark, d), lookup_queries(spark, d))


_REGEX_Q = """q AS (SELECT DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '[13579]$' AS query FROM nation
UNION SELECT '^c.*[0-9]' || CAST(r_regionkey AS VARCHAR) || '.$' FROM region)"""


@register("lookup_customer_regex", O.with_clean(f""", {_REGEX_Q}
SELECT query, min(customerID) AS customerID, 'contains' AS match_type
FROM q JOIN clean ON regexp_matches(customerID, query, 'i') GROUP BY query"""))
def q_lookup_customer_regex(spark, d):
    """P9/J2 with one pattern for each nation (found by its trigram) and region (no literal run)."""
    from retentio.sources.tables import read_table
    nations = read_table(spark, d, "nation", ["n_nationkey"]).select(
        F.concat(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit("[13579]$")).alias("query"))
    regions = read_table(spark, d, "region", ["r_regionkey"]).select(
        F.concat(F.lit("^c.*[0-9]"), F.col("r_regionkey").cast("string"), F.lit(".$")).alias("query"))
    return C.lookup_customer(clean_table(spark, d), nations.unionByName(regions))


_PROFILE_COLS = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "Contract",
                 "InternetService", "MonthlyCharges", "TotalCharges", "PaymentMethod"]


@register("customer_profile_long", O.with_clean("\nUNION ALL\n".join(
    f"SELECT customerID, {i + 1} AS pos, '{c}' AS Feature, "
    + (f"printf('%.2f', {c})" if c in ("MonthlyCharges", "TotalCharges") else f"CAST({c} AS VARCHAR)")
    + " AS Value FROM clean" for i, c in enumerate(_PROFILE_COLS))))
def q_customer_profile_long(spark, d):
    return C.customer_profile_long(clean_table(spark, d), _PROFILE_COLS)


@register("sample_ids", O.with_clean("SELECT customerID FROM clean ORDER BY md5(customerID || '42'), customerID LIMIT 6"))
def q_sample_ids(spark, d):
    return C.sample_ids(clean_table(spark, d), 6, 42)


def _long_onehot(df: DataFrame, levels: dict, drop_first: bool, id_col: str = "customerID"):
    enc = FE.one_hot(df.select(id_col, *levels.keys()), levels, drop_first=drop_first)
    feats = [c for c in enc.columns if c != id_col]
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"))
                    for f in feats])
    return enc.select(id_col, F.inline(arr))


def _onehot_sql(drop_first: bool, src: str = "clean") -> str:
    parts = []
    for c in _CATS:
        lv = (f"(SELECT v FROM (SELECT DISTINCT {c} AS v FROM clean WHERE {c} IS NOT NULL) "
              f"ORDER BY v OFFSET {1 if drop_first else 0})")
        parts.append(f"SELECT s.customerID, '{c}_' || l.v AS feature, "
                     f"CAST(coalesce(s.{c} = l.v, false) AS INTEGER) AS value FROM {src} s, {lv} l")
    return "\nUNION ALL\n".join(parts)


@register("one_hot_all", O.with_clean(_onehot_sql(False)))
def q_one_hot_all(spark, d):
    c = clean_table(spark, d)
    return _long_onehot(c, FE.categorical_levels(c, _CATS), False)


@register("one_hot_drop_first", O.with_clean(_onehot_sql(True)))
def q_one_hot_drop_first(spark, d):
    c = clean_table(spark, d)
    return _long_onehot(c, FE.categorical_levels(c, _CATS), True)


@register("encode_frozen", O.with_clean(", raw_t AS (SELECT * FROM subscribers_raw)\n"
                                        + _onehot_sql(True, "raw_t")))
def q_encode_frozen(spark, d):
    """levels frozen on the clean table, applied to the raw (untrimmed) rows."""
    c = clean_table(spark, d)
    levels = FE.categorical_levels(c, _CATS)
    return _long_onehot(raw(spark, d), levels, True)


# The levels that the subscriber view can give.
_YES_NO = ["No", "Yes"]
_SERVICE = ["No", "No internet service", "Yes"]
_LEVELS = {
    "gender": ["Female", "Male"], "Partner": _YES_NO, "Dependents": _YES_NO, "PhoneService": _YES_NO,
    "MultipleLines": ["No", "No phone service", "Yes"], "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": _SERVICE, "OnlineBackup": _SERVICE, "DeviceProtection": _SERVICE, "TechSupport": _SERVICE,
    "StreamingTV": _SERVICE, "StreamingMovies": _SERVICE, "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": _YES_NO,
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"]}


def _frame_sql(drop_first: bool, src: str = "clean") -> str:
    out = [f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\""
           for c in _CATS for v in _LEVELS[c][drop_first:]]
    return f"SELECT * EXCLUDE ({', '.join(_CATS)}), {', '.join(out)} FROM {src}"


@register("one_hot_all_frame", O.with_clean(_frame_sql(False)))
def q_one_hot_all_frame(spark, d):
    """F7 as a frame: one row for each subscriber, a 0/1 column for each level."""
    return FE.one_hot_all(clean_table(spark, d))


@register("one_hot_drop_first_frame", O.with_clean(_frame_sql(True)))
def q_one_hot_drop_first_frame(spark, d):
    """F8 as a frame."""
    return FE.one_hot_drop_first(clean_table(spark, d))


@register("encode_frozen_frame", O.with_clean(", raw_t AS (SELECT customerID, " + ", ".join(_LEVELS) + " FROM subscribers_raw)\n"
                                              + _frame_sql(True, "raw_t")))
def q_encode_frozen_frame(spark, d):
    """F9 as a frame: levels of the clean table, rows of the raw one."""
    levels = FE.categorical_levels(clean_table(spark, d), _CATS)
    return FE.one_hot(raw(spark, d).select("customerID", *levels), levels, drop_first=True)


#: Weights of a fixed linear score over standardised columns, for attributions that SQL can restate.
_WEIGHTS = {
    "tenure": -1.2, "MonthlyCharges": 0.7, "TotalCharges": -0.4, "SeniorCitizen": 0.15, "Contract_One year": -0.5,
    "Contract_Two year": -0.9, "InternetService_Fiber optic": 0.6, "PaperlessBilling_Yes": 0.2, "TechSupport_Yes": -0.3,
    "PaymentMethod_Electronic check": 0.35, "Partner_Yes": -0.1, "Dependents_Yes": -0.12, "OnlineSecurity_Yes": -0.25,
    "MultipleLines_Yes": 0.08}


def _weighted_sql() -> str:
    exprs = {}
    for name in _WEIGHTS:
        col, _, level = name.partition("_")
        exprs[name] = f"CAST(coalesce({col} = '{level}', false) AS DOUBLE)" if level else f"CAST({name} AS DOUBLE)"
    return ", long AS (" + "\nUNION ALL\n".join(
        f"SELECT customerID, '{n}' AS feature, {e} AS value, CAST({w} AS DOUBLE) AS w FROM clean"
        for (n, e), w in zip(exprs.items(), _WEIGHTS.values())) + """),
mo AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY feature),
attr AS (SELECT customerID, feature, value, round(w * ((value - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END), 8) AS shap
         FROM long JOIN mo USING (feature)),
top AS (SELECT * FROM attr QUALIFY row_number() OVER (PARTITION BY customerID ORDER BY abs(shap) DESC, feature) <= 12)
"""


def weighted_attributions(spark, d) -> DataFrame:
    levels: dict[str, list] = {}
    for name in _WEIGHTS:
        col, _, level = name.partition("_")
        if level:
            levels.setdefault(col, []).append(level)
    plain = [n for n in _WEIGHTS if "_" not in n]
    return EX.shap_weights_arrays(FE.one_hot(clean_table(spark, d).select("customerID", *plain, *levels), levels), _WEIGHTS)


@register("weighted_attributions", O.with_clean(_weighted_sql() + "SELECT * FROM attr"))
def q_weighted_attributions(spark, d):
    """X5 of a fixed linear score, for every subscriber and feature."""
    return weighted_attributions(spark, d).select("customerID", F.inline("attr"))


@register("weighted_top_attributions", O.with_clean(_weighted_sql() + """SELECT *, row_number() OVER (
  PARTITION BY customerID ORDER BY shap, feature) AS pos FROM top"""))
def q_weighted_top_attributions(spark, d):
    """T3 of a fixed linear score."""
    return EX.top_attributions(weighted_attributions(spark, d), 12)


@register("weighted_reasons", O.with_clean(_weighted_sql() + """SELECT * FROM (
  SELECT customerID, 'increases risk' AS direction, row_number() OVER (PARTITION BY customerID ORDER BY shap DESC, feature) AS rank,
         feature, value, shap FROM top WHERE shap > 0) WHERE rank <= 3
UNION ALL SELECT * FROM (
  SELECT customerID, 'reduces risk' AS direction, row_number() OVER (PARTITION BY customerID ORDER BY shap, feature) AS rank,
         feature, value, shap FROM top WHERE shap < 0) WHERE rank <= 2"""))
def q_weighted_reasons(spark, d):
    """X6 of a fixed linear score."""
    return EX.attribution_reasons(weighted_attributions(spark, d))


_STD_COLS = ["tenure", "MonthlyCharges", "TotalCharges"]


@register("standardize", O.with_clean(", m AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _STD_COLS) + " FROM clean)\nSELECT customerID, "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 8) AS {c}"
                for c in _STD_COLS) + " FROM clean, m"))
def q_standardize(spark, d):
    s = FE.standardize(clean_table(spark, d), _STD_COLS)
    return s.select("customerID", *[F.round(F.col(c), 8).alias(c) for c in _STD_COLS])


@register("clv_histogram", O.with_life(""", sc AS (SELECT MonthlyCharges,
      (1.0 - tenure / max(tenure) OVER ()) * CAST(0.6 AS DOUBLE) AS churn_prob FROM clean),
atr AS (SELECT MonthlyCharges * implied_lifetime * CAST(0.25 AS DOUBLE) * CAST(83.0 AS DOUBLE) AS CLV
        FROM sc, life WHERE churn_prob >= 0.5),
rng AS (SELECT min(CLV) AS lo, max(CLV) AS hi FROM atr WHERE CLV IS NOT NULL),
hb AS (SELECT lo, hi, CAST(CASE WHEN hi > lo THEN least(CAST(floor((CLV - lo) / (hi - lo) * 40) AS BIGINT) + 1, 40)
              ELSE 1 END AS BIGINT) AS bin FROM atr, rng WHERE CLV IS NOT NULL)
SELECT bin, count(*) AS count, first(lo + (bin - 1) * ((hi - lo) / 40)) AS bin_lo,
       first(lo + bin * ((hi - lo) / 40)) AS bin_hi FROM hb GROUP BY bin"""))
def q_clv_histogram(spark, d):
    """A14 on the ROI page: 40 equal-width bins of at-risk CLV."""
    scored = X.with_heuristic_score(clean_table(spark, d))
    life = X.lift_rates(scored).select("implied_lifetime")
    at = (with_scalars(scored.filter(F.col("churn_prob") >= 0.5), life)
          .select(X.clv_roi(lifetime=F.col("implied_lifetime")).alias("CLV")))
    return P.histogram(at, "CLV", 40)
