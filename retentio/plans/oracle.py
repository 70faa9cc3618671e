"""DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each operator over the driver's tables, independently of the
Spark code: the subscriber view, cleaning and features are CTEs, and every
query is ``WITH <ctes> <body>``.  Tie-break contract: ``customerID`` ascending.
"""

from __future__ import annotations

_SVC = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]

RAW_CTE = """
o AS (
  SELECT o_custkey AS ck, count(*) AS n,
         min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS tot,
         count_if(o_orderpriority = '1-URGENT') AS p1,
         count_if(o_orderpriority = '2-HIGH') AS p2,
         count_if(o_orderpriority = '3-MEDIUM') AS p3,
         count_if(o_orderpriority = '4-NOT SPECIFIED') AS p4,
         count_if(o_orderpriority = '5-LOW') AS p5,
         count_if(o_orderstatus = 'F') AS sF,
         count_if(o_orderstatus = 'O') AS sO,
         count_if(o_orderstatus = 'P') AS sP
  FROM orders GROUP BY o_custkey),
b AS (
  SELECT c.c_custkey AS k, c.c_nationkey, c.c_acctbal, c.c_mktsegment, r.r_name, o.*,
         CAST(date_diff('day', o.f, o.l) // 30 AS INTEGER) AS tenure,
         (SELECT max(l) FROM o) AS as_of
  FROM customer c JOIN o ON c.c_custkey = o.ck
  JOIN nation nn ON c.c_nationkey = nn.n_nationkey
  JOIN region r ON nn.n_regionkey = r.r_regionkey),
subscribers_raw AS (
  SELECT 'CUST-' || lpad(CAST(k AS VARCHAR), 8, '0') AS customerID,
    CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS SeniorCitizen,
    CASE WHEN c_acctbal > 4500 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
    tenure,
    CASE WHEN sO >= 1 THEN 'Yes' ELSE 'No' END AS PhoneService,
    CASE WHEN sO = 0 THEN 'No phone service' WHEN sP >= 4 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE WHEN r_name = 'AFRICA' THEN 'No' WHEN r_name IN ('AMERICA', 'ASIA') THEN 'DSL'
         ELSE 'Fiber optic' END AS InternetService,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN p1 >= 3 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN p2 >= 3 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN p3 >= 3 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN p4 >= 3 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN p5 >= 3 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN r_name = 'AFRICA' THEN 'No internet service' WHEN sF >= 4 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE WHEN n < 8 THEN 'Month-to-month' WHEN n < 12 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN 2 * sF > n THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Electronic check'
         WHEN 'FURNITURE' THEN 'Bank transfer (automatic)'
         WHEN 'AUTOMOBILE' THEN 'Credit card (automatic)' ELSE 'Mailed check' END AS PaymentMethod,
    CAST(tot AS DOUBLE) / greatest(tenure, 1) AS MonthlyCharges,
    CASE WHEN tenure = 0 THEN ' ' ELSE CAST(tot AS VARCHAR) END AS TotalCharges,
    CASE WHEN date_diff('day', l, as_of) > 365 THEN 'Yes' ELSE 'No' END AS Churn
  FROM b)"""

_STR_COLS = ["customerID", "gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
             "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
             "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
             "PaymentMethod"]

CLEAN_CTE = RAW_CTE + """,
coerced AS (SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges)
            FROM subscribers_raw),
deduped AS (SELECT DISTINCT * FROM coerced),
clean AS (
  SELECT trim(customerID) AS customerID, trim(gender) AS gender, SeniorCitizen,
    trim(Partner) AS Partner, trim(Dependents) AS Dependents, tenure,
    trim(PhoneService) AS PhoneService, trim(MultipleLines) AS MultipleLines,
    trim(InternetService) AS InternetService, trim(OnlineSecurity) AS OnlineSecurity,
    trim(OnlineBackup) AS OnlineBackup, trim(DeviceProtection) AS DeviceProtection,
    trim(TechSupport) AS TechSupport, trim(StreamingTV) AS StreamingTV,
    trim(StreamingMovies) AS StreamingMovies, trim(Contract) AS Contract,
    trim(PaperlessBilling) AS PaperlessBilling, trim(PaymentMethod) AS PaymentMethod,
    MonthlyCharges, coalesce(TotalCharges, 0) AS TotalCharges,
    CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS Churn
  FROM deduped)"""

_ENG = " + ".join(f"CAST(coalesce({c} = 'Yes', false) AS INTEGER)" for c in _SVC)


def quintile_rank_sql(rn: str, n: str) -> str:
    return (f"CAST(CASE WHEN {n} <= 1 THEN 1 ELSE greatest(1, (5 * ({rn} - 1) + {n} - 2) "
            f"// ({n} - 1)) END AS INTEGER)")


FEAT_CTE = CLEAN_CTE + f""",
f1 AS (
  SELECT *,
    CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-12 months'
         WHEN tenure > 12 AND tenure <= 24 THEN '12-24 months'
         WHEN tenure > 24 AND tenure <= 48 THEN '24-48 months'
         WHEN tenure > 48 AND tenure <= 72 THEN '48+ months' END AS tenure_group,
    {_ENG} AS engagement_score,
    CASE WHEN tenure > 0 THEN TotalCharges / tenure ELSE MonthlyCharges END AS charges_per_month
  FROM clean),
f2 AS (
  SELECT *, CAST(max(tenure) OVER () - tenure AS INTEGER) AS recency,
         engagement_score AS frequency, TotalCharges AS monetary
  FROM f1),
edges AS (
  SELECT CAST(min(recency) AS DOUBLE) AS e0, quantile_cont(recency, 0.2) AS e1,
         quantile_cont(recency, 0.4) AS e2, quantile_cont(recency, 0.6) AS e3,
         quantile_cont(recency, 0.8) AS e4
  FROM f2),
f3 AS (
  SELECT f2.*,
    CAST(5 - (CAST(e1 < recency AND e1 > e0 AS INTEGER) + CAST(e2 < recency AND e2 > e1 AS INTEGER)
            + CAST(e3 < recency AND e3 > e2 AS INTEGER) + CAST(e4 < recency AND e4 > e3 AS INTEGER))
         AS INTEGER) AS R_Score,
    row_number() OVER (ORDER BY frequency, customerID) AS rn_f,
    row_number() OVER (ORDER BY monetary, customerID) AS rn_m,
    count(*) OVER () AS n_all
  FROM f2, edges),
f4 AS (
  SELECT * EXCLUDE (rn_f, rn_m, n_all),
    {quintile_rank_sql('rn_f', 'n_all')} AS F_Score,
    {quintile_rank_sql('rn_m', 'n_all')} AS M_Score
  FROM f3),
feat AS (
  SELECT *, R_Score + F_Score + M_Score AS RFM_Score,
    CASE WHEN R_Score + F_Score + M_Score >= 12 THEN 'Champions'
         WHEN R_Score + F_Score + M_Score >= 9 THEN 'Loyal Customers'
         WHEN R_Score + F_Score + M_Score >= 6 THEN 'Potential Loyalists'
         WHEN R_Score + F_Score + M_Score >= 4 THEN 'At Risk' ELSE 'Lost' END AS RFM_Segment
  FROM f4)"""


def pct1(num: str, den: str) -> str:
    """Percentage to 1 dp, ties to even (DuckDB's own rounding)."""
    return f"round_even(100.0 * CAST({num} AS DOUBLE) / {den}, 1)"


def with_raw(body: str) -> str:
    return "WITH " + RAW_CTE + "\n" + body


def with_clean(body: str) -> str:
    return "WITH " + CLEAN_CTE + "\n" + body


def with_feat(body: str) -> str:
    return "WITH " + FEAT_CTE + "\n" + body


SCORED_CTE = """,
scored AS (
  SELECT customerID, Churn AS label, tenure, MonthlyCharges,
         (1.0 - tenure / max(tenure) OVER ()) * CAST(0.6 AS DOUBLE) AS score
  FROM clean)"""

CUM_CTE = """,
sc AS (SELECT CAST(score AS DOUBLE) AS threshold, count_if(label = 1) AS pos,
              count_if(label = 0) AS neg
       FROM scored WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY 1),
cum AS (SELECT *,
          CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tp,
          CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_fp,
          CAST(sum(pos) OVER () AS BIGINT) AS all_tp, CAST(sum(neg) OVER () AS BIGINT) AS all_fp
        FROM sc)"""


def sdiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END)"


def half_even(a: str, b: str) -> str:
    """round(a / b) ties-to-even for integer a, positive integer b (HUGEINT arithmetic)."""
    A, B = f"CAST({a} AS HUGEINT)", f"CAST({b} AS HUGEINT)"
    r = f"((({A}) % ({B}) + ({B})) % ({B}))"
    q = f"(({A}) - {r}) // ({B})"
    return (f"CAST(CASE WHEN 2 * {r} > {B} THEN {q} + 1 WHEN 2 * {r} < {B} THEN {q} "
            f"ELSE {q} + ((({q}) % 2 + 2) % 2) END AS BIGINT)")


LIFE_CTE = """,
lr0 AS (
  SELECT
    CASE WHEN count(CASE WHEN Contract = 'Month-to-month' THEN Churn END) > 0
         THEN CAST(sum(CASE WHEN Contract = 'Month-to-month' THEN Churn END) AS BIGINT) ELSE 43 END AS s1,
    CASE WHEN count(CASE WHEN Contract = 'Month-to-month' THEN Churn END) > 0
         THEN count(CASE WHEN Contract = 'Month-to-month' THEN Churn END) ELSE 100 END AS c1,
    CASE WHEN count(CASE WHEN Contract = 'One year' THEN Churn END) > 0
         THEN CAST(sum(CASE WHEN Contract = 'One year' THEN Churn END) AS BIGINT) ELSE 11 END AS s2,
    CASE WHEN count(CASE WHEN Contract = 'One year' THEN Churn END) > 0
         THEN count(CASE WHEN Contract = 'One year' THEN Churn END) ELSE 100 END AS c2,
    CASE WHEN count(CASE WHEN Contract = 'Two year' THEN Churn END) > 0
         THEN CAST(sum(CASE WHEN Contract = 'Two year' THEN Churn END) AS BIGINT) ELSE 3 END AS s3,
    CASE WHEN count(CASE WHEN Contract = 'Two year' THEN Churn END) > 0
         THEN count(CASE WHEN Contract = 'Two year' THEN Churn END) ELSE 100 END AS c3,
    CAST(sum(Churn) AS BIGINT) AS s, count(Churn) AS c
  FROM clean),
lr1 AS (
  SELECT *, """ + half_even("100 * (CAST(s1 AS HUGEINT) * c3 - CAST(s3 AS HUGEINT) * c1)",
                            "CAST(c1 AS HUGEINT) * c3") + """ AS k_prem,
         """ + half_even("100 * (CAST(s1 AS HUGEINT) * c2 - CAST(s2 AS HUGEINT) * c1)",
                         "CAST(c1 AS HUGEINT) * c2") + """ AS k_std
  FROM lr0),
life AS (
  SELECT CAST(k_prem AS DOUBLE) / 100 AS lift_premium, CAST(k_std AS DOUBLE) / 100 AS lift_standard,
         CAST(""" + half_even("6 * k_std", "10") + """ AS DOUBLE) / 100 AS lift_basic,
         CAST(""" + half_even("k_std", "4") + """ AS DOUBLE) / 100 AS lift_minimal,
         CASE WHEN c > 0 THEN CAST(s AS DOUBLE) / CAST(c AS DOUBLE) END AS base_churn,
         CASE WHEN s > 0 THEN """ + half_even("c", "s") + """ ELSE 24 END AS implied_lifetime
  FROM lr1)"""


def with_scored(body: str) -> str:
    return "WITH " + CLEAN_CTE + SCORED_CTE + "\n" + body


def with_cum(body: str) -> str:
    return "WITH " + CLEAN_CTE + SCORED_CTE + CUM_CTE + "\n" + body


def with_life(body: str) -> str:
    return "WITH " + CLEAN_CTE + LIFE_CTE + "\n" + body
