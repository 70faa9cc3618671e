"""Scalar expressions used by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  Spark 4 runs with ANSI on: casts that may
fail use ``try_cast``; divisions that may hit zero use ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = [
    "SERVICE_COLUMNS", "TENURE_LABELS", "SEGMENT_LABELS", "coerce_numeric",
    "tenure_group", "engagement_score", "charges_per_month", "segment_label",
    "risk_tier", "retention_action", "clv_lookup", "clv_simulator", "clv_roi",
    "heuristic_score", "pct_1dp", "half_even_quotient", "quintile_from_rank",
    "quintile_from_edges",
]

# The eight service columns counted by the engagement score.
SERVICE_COLUMNS = [
    "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
]

# Tenure bucket labels for (0,12], (12,24], (24,48], (48,72].
TENURE_LABELS = ["0-12 months", "12-24 months", "24-48 months", "48+ months"]

# RFM segment labels with their minimum score (checked top-down).
SEGMENT_LABELS = [
    (12, "Champions"), (9, "Loyal Customers"), (6, "Potential Loyalists"),
    (4, "At Risk"), (None, "Lost"),
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c) -> Column:
    """Lenient string -> double; blanks and junk become NULL."""
    return F.trim(_c(c)).try_cast("double")


def tenure_group(tenure="tenure") -> Column:
    """right-closed buckets; 0 and > 72 give NULL (no include_lowest)."""
    t = _c(tenure)
    edges = [0, 12, 24, 48, 72]
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], TENURE_LABELS):
        cond = (t > lo) & (t <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def engagement_score(columns: list[str]) -> Column:
    """count of 'Yes' over the given (existing) service columns; NULL counts 0."""
    if not columns:
        return F.lit(0)
    terms = [F.col(c).eqNullSafe("Yes").cast("int") for c in columns]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def charges_per_month(total="TotalCharges", tenure="tenure", monthly="MonthlyCharges") -> Column:
    """total / tenure when tenure > 0, else the monthly charge."""
    return F.when(_c(tenure) > 0, _c(total) / _c(tenure)).otherwise(_c(monthly))


def segment_label(score="RFM_Score") -> Column:
    """RFM segment from the summed score."""
    s = _c(score)
    expr = None
    for lo, lab in SEGMENT_LABELS:
        if lo is None:
            return expr.otherwise(lab)
        expr = F.when(s >= lo, lab) if expr is None else expr.when(s >= lo, lab)
    return expr


def risk_tier(prob="churn_prob", high: float = 0.65, medium: float = 0.35,
              strict: bool = False) -> Column:
    """HIGH / MEDIUM / LOW RISK (``strict`` uses '>' as the simulator does)."""
    p = _c(prob)
    ge = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    return (F.when(ge(p, F.lit(high)), "HIGH RISK")
            .when(ge(p, F.lit(medium)), "MEDIUM RISK").otherwise("LOW RISK"))


# Next-best-action rules (action, reason, cost INR, lift %); the emoji in front of an action are left out.
_ACTIONS = [
    ("Personal Manager + 20% Discount",
     "Immediate personal outreach. High-value at critical risk.", 500, 40),
    ("Targeted 15% Discount", "Send personalised discount via email/SMS within 24h.", 200, 30),
    ("Loyalty Rewards + Upgrade Offer",
     "Reward tenure with a free service upgrade for 3 months.", 300, 20),
    ("Automated Re-engagement", "Email + push notification nurture sequence.", 50, 15),
    ("Monitor — Low Risk", "Continue standard experience. Review in 3 months.", 10, 5),
]


def retention_action(prob="churn_prob", clv="CLV", high: float = 0.65, medium: float = 0.35,
                     clv_high: float = 500.0, clv_mid: float = 300.0) -> Column:
    """struct(action, reason, cost, lift) from (prob, clv)."""
    p, v = _c(prob), _c(clv)
    conds = [(p >= high) & (v >= clv_high), p >= high, (p >= medium) & (v >= clv_mid),
             p >= medium]

    def st(i):
        a, r, c, li = _ACTIONS[i]
        return F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"),
                        F.lit(c).alias("cost"), F.lit(li).alias("lift_pct"))

    expr = F.when(conds[0], st(0))
    for i in range(1, 4):
        expr = expr.when(conds[i], st(i))
    return expr.otherwise(st(4))


def clv_lookup(monthly="MonthlyCharges", tenure="tenure", margin=0.25, rate=83.0) -> Column:
    """X4 (lookup): monthly * tenure * margin * rate."""
    return _c(monthly) * _c(tenure) * F.lit(float(margin)) * F.lit(float(rate))


def clv_simulator(monthly="MonthlyCharges", tenure="tenure", margin=0.25, rate=83.0) -> Column:
    """X4 (simulator): monthly * max(tenure, 1) * margin * rate."""
    return (_c(monthly) * F.greatest(_c(tenure), F.lit(1)) * F.lit(float(margin))
            * F.lit(float(rate)))


def clv_roi(monthly="MonthlyCharges", lifetime=12, margin=0.25, rate=83.0) -> Column:
    """X4 (ROI page): monthly * expected lifetime * margin * rate."""
    life = _c(lifetime) if isinstance(lifetime, (str, Column)) else F.lit(lifetime)
    return _c(monthly) * life * F.lit(float(margin)) * F.lit(float(rate))


def heuristic_score(tenure="tenure", max_tenure="max_tenure", weight: float = 0.6) -> Column:
    """(1 - tenure / max(tenure)) * 0.6; max 0 -> NULL-safe via try_divide."""
    return (F.lit(1.0) - F.try_divide(_c(tenure), _c(max_tenure))) * F.lit(float(weight))


def pct_1dp(num, den) -> Column:
    """100 * num / den rounded to 1 dp with ties to even, in exact integer arithmetic.

    That is pandas' ``(rate * 100).round(1)`` without engine-specific rounding of
    binary doubles; num and den are non-negative counts.
    """
    n, d = _c(num).cast("long"), _c(den).cast("long")
    return half_even_quotient(F.lit(1000) * n, d) / F.lit(10.0)


def half_even_quotient(num, den) -> Column:
    """round(num / den) with ties to even, for whole non-negative num; NULL unless den > 0."""
    n, d = _c(num).cast("long"), _c(den).cast("long")
    q = F.when(d > 0, _int_div(n, d))
    twice = (n - q * d) * 2
    up = (twice > d) | ((twice == d) & (F.pmod(q, F.lit(2)) == 1))
    return q + up.cast("long")


def _int_div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative longs (< 2**53): (a - a mod b) / b."""
    a, b = a.cast("long"), b.cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def quintile_from_rank(rn="rn", n="n_total") -> Column:
    """``qcut(rank, 5)`` label 1..5 as exact integer arithmetic.

    Edges of ranks 1..n are ``1 + k(n-1)/5``; the label is the smallest k with
    ``rn <= 1 + k(n-1)/5``, i.e. ``ceil(5(rn-1)/(n-1))``, at least 1.
    """
    r, m = _c(rn).cast("long"), _c(n).cast("long")
    num = F.lit(5) * (r - 1) + m - 2
    return F.when(m <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), _int_div(num, m - 1).cast("int"))).cast("int")


def quintile_from_edges(x, edges: list[Column], reverse: bool = True) -> Column:
    """Right-closed quintile of a value given the four interior edges.

    ``edges`` are e0 (min), e1..e4 (20/40/60/80 % quantiles).  The bin is the
    number of *distinct* interior edges below x (collapsed edges are skipped
    instead of failing).  ``reverse`` gives labels 5..1.
    """
    v = _c(x)
    b = None
    for j in range(1, 5):
        t = ((edges[j] < v) & (edges[j] > edges[j - 1])).cast("int")
        b = t if b is None else b + t
    return (F.lit(5) - b) if reverse else (b + 1)
