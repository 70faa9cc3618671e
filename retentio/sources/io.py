"""Scans and sinks for subscriber tables, metrics tables and derived tables.

* S1 ``scan_subscribers``: CSV with header and an explicit schema (no schema
  inference pass over the data), or Parquet.
* S2 ``load_or_build``: read a processed table if present, else build it from
  the raw source and (optionally) write it for the next run.
* S3 ``table_available``: path / catalog existence check.
* S4/S6/S7 ``save_table`` / ``load_table``: Parquet round trip (optionally
  partitioned, e.g. by the ``split`` column of the feature table).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)

_STR = StringType()

SUBSCRIBER_SCHEMA = StructType([
    StructField("customerID", _STR), StructField("gender", _STR),
    StructField("SeniorCitizen", IntegerType()), StructField("Partner", _STR),
    StructField("Dependents", _STR), StructField("tenure", IntegerType()),
    StructField("PhoneService", _STR), StructField("MultipleLines", _STR),
    StructField("InternetService", _STR), StructField("OnlineSecurity", _STR),
    StructField("OnlineBackup", _STR), StructField("DeviceProtection", _STR),
    StructField("TechSupport", _STR), StructField("StreamingTV", _STR),
    StructField("StreamingMovies", _STR), StructField("Contract", _STR),
    StructField("PaperlessBilling", _STR), StructField("PaymentMethod", _STR),
    StructField("MonthlyCharges", DoubleType()), StructField("TotalCharges", _STR),
    StructField("Churn", _STR),
])


def scan_subscribers(spark: SparkSession, path: str, fmt: str = "csv",
                     schema: StructType = SUBSCRIBER_SCHEMA) -> DataFrame:
    """Read a raw subscriber table. CSV keeps TotalCharges a string (blank-safe)."""
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True)
                .option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False)
                .csv(path))
    return spark.read.format(fmt).load(path)


def table_available(spark: SparkSession, path_or_table: str) -> bool:
    """True if a catalog table or a readable path exists (no data is scanned)."""
    if "/" not in path_or_table and spark.catalog.tableExists(path_or_table):
        return True
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path_or_table)
    return bool(p.getFileSystem(hconf).exists(p))


def save_table(df: DataFrame, path: str, fmt: str = "parquet",
               partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # keep blank strings such as TotalCharges ' ' byte-for-byte
        w = (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", False)
    return r.load(path)


def load_or_build(spark: SparkSession, processed_path: str,
                  build: Callable[[], DataFrame], persist_built: bool = True) -> DataFrame:
    """The processed table if it exists, otherwise ``build()`` (written back once)."""
    if table_available(spark, processed_path):
        return load_table(spark, processed_path)
    df = build()
    if persist_built:
        save_table(df, processed_path)
        return load_table(spark, processed_path)
    return df


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a stored table, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
