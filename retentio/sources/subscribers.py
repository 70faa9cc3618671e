"""Subscriber view derived from the driver's TPC-H-like tables.

One row per customer with at least one order, in the 21-column raw subscriber
schema.  Plan shape at scale:

* ``orders`` is pruned to six columns and aggregated per ``o_custkey``
  (partial aggregation map-side, one shuffle on the customer key);
* ``as_of`` is a global max over one pruned column of ``orders`` (partial max
  per task, no row shuffle), a one-row result attached as a scalar subquery;
* ``customer`` joins the aggregate on the customer key, so only the customer
  side is exchanged; ``nation`` x ``region`` is a fixed 25-row dimension and is
  broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retentio.sources.tables import read_table
from retentio.operators.scalars import with_scalars

# Raw column order of the subscriber table.
RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer order statistics (one shuffle on o_custkey)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority",
                    "o_orderstatus"])
    d = F.to_date("o_orderdate")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min(d).alias("f"),
        F.max(d).alias("l"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("tot"),
    ]
    aggs += [F.count_if(F.col("o_orderpriority") == p).alias(f"p{i + 1}")
             for i, p in enumerate(_PRIORITIES)]
    aggs += [F.count_if(F.col("o_orderstatus") == s).alias(f"s{s}") for s in "FOP"]
    return o.groupBy("o_custkey").agg(*aggs)


def subscribers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw 21-column subscriber table (strings, ints, doubles; TotalCharges a string)."""
    prof = order_profile(spark, sf_dir)
    # global max order date: a one-column scan with per-task partial max, no row shuffle
    as_of = (read_table(spark, sf_dir, "orders", ["o_orderdate"])
             .agg(F.max(F.to_date("o_orderdate")).alias("as_of")))
    cust = read_table(spark, sf_dir, "customer",
                      ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    geo = (read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
           .join(read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    b = (with_scalars(cust.join(prof, cust.c_custkey == prof.o_custkey)
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")), as_of)
         .withColumn("tenure", (F.datediff("l", "f") / F.lit(30)).cast("int")))
    k = F.col("c_custkey")
    yes_no = lambda cond: F.when(cond, "Yes").otherwise("No")
    internet = (F.when(F.col("r_name") == "AFRICA", "No")
                .when(F.col("r_name").isin("AMERICA", "ASIA"), "DSL")
                .otherwise("Fiber optic"))

    def service(cond):
        return F.when(internet == "No", "No internet service").otherwise(yes_no(cond))

    cols = {
        "customerID": F.concat(F.lit("CUST-"), F.lpad(k.cast("string"), 8, "0")),
        "gender": F.when(k % 2 == 0, "Male").otherwise("Female"),
        "SeniorCitizen": F.when(k % 6 == 0, 1).otherwise(0).cast("int"),
        "Partner": yes_no(F.col("c_acctbal") > 4500),
        "Dependents": yes_no(F.col("c_nationkey") % 3 == 0),
        "tenure": F.col("tenure"),
        "PhoneService": yes_no(F.col("sO") >= 1),
        "MultipleLines": F.when(F.col("sO") == 0, "No phone service")
                          .otherwise(yes_no(F.col("sP") >= 4)),
        "InternetService": internet,
        "OnlineSecurity": service(F.col("p1") >= 3),
        "OnlineBackup": service(F.col("p2") >= 3),
        "DeviceProtection": service(F.col("p3") >= 3),
        "TechSupport": service(F.col("p4") >= 3),
        "StreamingTV": service(F.col("p5") >= 3),
        "StreamingMovies": service(F.col("sF") >= 4),
        "Contract": F.when(F.col("n") < 8, "Month-to-month")
                     .when(F.col("n") < 12, "One year").otherwise("Two year"),
        "PaperlessBilling": yes_no(2 * F.col("sF") > F.col("n")),
        "PaymentMethod": F.when(F.col("c_mktsegment") == "BUILDING", "Electronic check")
                          .when(F.col("c_mktsegment") == "FURNITURE", "Bank transfer (automatic)")
                          .when(F.col("c_mktsegment") == "AUTOMOBILE", "Credit card (automatic)")
                          .otherwise("Mailed check"),
        "MonthlyCharges": F.col("tot").cast("double") / F.greatest(F.col("tenure"), F.lit(1)),
        "TotalCharges": F.when(F.col("tenure") == 0, " ").otherwise(F.col("tot").cast("string")),
        "Churn": yes_no(F.datediff("as_of", "l") > 365),
    }
    return b.select(*[c.alias(n) for n, c in cols.items()])
