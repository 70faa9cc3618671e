"""Profiling and distribution statistics.

All per-column statistics are computed in one aggregation pass and then
unpivoted; exact quantiles of continuous columns are selected (``operators.selection``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from retentio.operators.clean import string_columns
from retentio.operators.scalars import with_scalars
from retentio.operators.selection import exact_quantiles, exact_quantiles_of


def _unpivot_one_row(one: DataFrame, cols: list[str], value_name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("column"),
                               F.col(f"`{c}`").alias(value_name)) for i, c in enumerate(cols)])
    return one.select(F.inline(pairs))


def null_counts(df: DataFrame) -> DataFrame:
    """(pos, column, null_count) for every column, one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _unpivot_one_row(one, df.columns, "null_count")


def duplicate_count(df: DataFrame) -> DataFrame:
    """A10: rows minus distinct rows, in one pass: group by every column (partial
    aggregation map-side), then sum the group sizes and count the groups."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").cast("long").alias("rows"),
                      F.count(F.lit(1)).alias("distinct_rows")).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_rows"))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column.

    Exact mode turns rows into (column, value) pairs and de-duplicates them
    (partial dedup map-side), instead of one multi-distinct aggregate; the
    approximate mode is one HyperLogLog++ pass.
    """
    cols = df.columns
    if approximate:
        one = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in cols])
        return _unpivot_one_row(one, cols, "distinct_count")
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("column"),
                               F.col(f"`{c}`").cast("string").alias("v"))
                      for i, c in enumerate(cols)])
    long = df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
    counted = long.dropDuplicates(["pos", "column", "v"]).groupBy("pos", "column").agg(
        F.count(F.lit(1)).alias("distinct_count"))
    allcols = df.sparkSession.createDataFrame(
        [(i + 1, c) for i, c in enumerate(cols)], "pos int, column string")
    return (F.broadcast(allcols).join(counted, ["pos", "column"], "left")
            .select("pos", "column", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")))


def data_dictionary(df: DataFrame, id_col: str = "customerID") -> DataFrame:
    """Name, Spark type, distinct count and a sample value (from the smallest id)."""
    types = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "pos int, column string, dtype string")
    sample = df.agg(*[F.min_by(F.col(f"`{c}`").cast("string"), F.col(id_col)).alias(c)
                      for c in df.columns])
    samples = _unpivot_one_row(sample, df.columns, "sample")
    return (types.join(distinct_counts(df), ["pos", "column"])
            .join(samples, ["pos", "column"]))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def describe_numeric(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, sample sd, min, 25/50/75 % (linear), max per numeric column.

    The columns are unpivoted to (column, value) so moments are one grouped
    aggregate; the quartiles of all columns are selected together, without a sort.
    """
    cols = cols or numeric_columns(df)
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("column"),
                               F.col(f"`{c}`").cast("double").alias("v"))
                      for i, c in enumerate(cols)])
    long = df.select(F.inline(pairs))
    mom = long.groupBy("pos", "column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = exact_quantiles_of(df, cols, [0.25, 0.5, 0.75])
    q = df.sparkSession.createDataFrame([(c, *quartiles[c]) for c in cols], "column string, p25 double, p50 double, p75 double")
    return mom.join(q, "column", "left").select(
        "pos", "column", "count",
        *[F.round(F.col(k), digits).alias(k) for k in
          ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def histogram(df: DataFrame, value: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of the whole column (shared by classes).

    bin = least(floor((x - lo) / (hi - lo) * bins) + 1, bins); the top edge falls
    in the last bin; a constant column puts everything in bin 1.
    """
    rng = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    x = F.col(value).cast("double")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((x - F.col("_lo")) / width * bins).cast("long") + 1,
                       F.lit(bins).cast("long"))).otherwise(F.lit(1).cast("long"))
    keys = ([by] if by else []) + ["bin"]
    binned = (with_scalars(df.filter(F.col(value).isNotNull()), rng)
              .withColumn("bin", b))
    return (binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.first(F.col("_lo") + (F.col("bin") - 1) * (width / bins)).alias("bin_lo"),
        F.first(F.col("_lo") + F.col("bin") * (width / bins)).alias("bin_hi")))


def class_density(df: DataFrame, value: str, by: str = "Churn", bins: int = 30) -> DataFrame:
    """Per-class share of rows in each equal-width bin (a finite violin)."""
    h = histogram(df, value, bins, by)
    tot = h.groupBy(by).agg(F.sum("count").alias("_tot"))
    return (h.join(F.broadcast(tot), by)
            .select(by, "bin", "count", (F.col("count") / F.col("_tot")).alias("share")))


def box_stats(df: DataFrame, value: str, by: str = "Churn", digits: int = 4) -> DataFrame:
    """Quartiles, IQR fences, whiskers and outlier count per class (values at ``digits`` dp)."""
    q = exact_quantiles(df.filter(F.col(by).isNotNull()), value, [0.25, 0.5, 0.75], by=by)
    q = q.select(by, F.col("q0").alias("q1"), F.col("q1").alias("median"),
                 F.col("q2").alias("q3"), "n")
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
         .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    x = F.col(value).cast("double")
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    w = (df.select(by, value).join(F.broadcast(q), by)
         .groupBy(by).agg(F.min(F.when(inside, x)).alias("whisker_low"),
                          F.max(F.when(inside, x)).alias("whisker_high"),
                          F.count_if(~inside).alias("outliers")))
    out = q.join(w, by)
    vals = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
    return out.select(by, "n", "outliers", *[F.round(F.col(c), digits).alias(c) for c in vals])


def target_correlation(df: DataFrame, target: str = "Churn",
                       exclude: tuple[str, ...] = ("customerID",), digits: int = 6) -> DataFrame:
    """Pearson correlation of each encoded column (one-hot of all levels) with the target, one pass.

    A row emits one pair for each column, not for each level: how often a level stands and the
    sum of its targets are all that the correlation of its 0/1 column needs, so levels are
    neither collected nor turned into columns. The partial aggregate leaves one row per level (or numeric column)
    per task. Columns without variance give NULL. Output (feature, correlation).
    """
    cats = [c for c in string_columns(df) if c not in exclude]
    nums = [c for c in numeric_columns(df) if c != target and c not in exclude]
    pair = lambda c, level, x: F.struct(
        F.lit(c).alias("name"), level.cast("string").alias("level"), x.cast("double").alias("_x"))
    pairs = F.array(*[pair(c, F.lit(None), F.col(f"`{c}`")) for c in nums],
                    *[pair(c, F.col(f"`{c}`"), F.lit(None)) for c in cats])
    x, y = F.col("_x"), F.col("_y")
    # corr() itself fails on a column without variance.
    deviations = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    stats = (df.select(F.col(target).cast("double").alias("_y"), F.inline(pairs)).groupBy("name", "level").agg(
        F.count(y).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.min(y).alias("low"),
        F.max(y).alias("high"), F.when(deviations > 0, F.try_divide(F.covar_pop(x, y), deviations)).alias("r")))
    # One row for each level: the column's totals are sums over its levels, the NULL one included.
    column = Window.partitionBy("name")
    n, sy, syy = (F.sum(c).over(column) for c in ("n", "sy", "syy"))
    varies = (F.col("n") > 0) & (F.col("n") < n) & (F.min("low").over(column) < F.max("high").over(column))
    level_r = F.when(varies, F.try_divide(n * F.col("sy") - F.col("n") * sy,
                                          F.sqrt((n * F.col("n") - F.col("n") * F.col("n")) * (n * syy - sy * sy))))
    numeric = F.col("name").isin(nums)
    return (stats.select(
        F.when(numeric, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("level"))).alias("feature"),
        F.round(F.when(numeric, F.col("r")).otherwise(level_r), digits).alias("correlation"), "level", numeric.alias("_numeric"))
        .filter(F.col("_numeric") | F.col("level").isNotNull()).select("feature", "correlation"))


def top_correlations(df: DataFrame, k: int = 5, target: str = "Churn") -> DataFrame:
    """T5: the k most positive and k most negative correlations (a small table)."""
    corr = target_correlation(df, target).filter(F.col("correlation").isNotNull())
    up = Window.orderBy(F.col("correlation").desc(), F.col("feature"))
    down = Window.orderBy(F.col("correlation").asc(), F.col("feature"))
    # the correlation table has one row per encoded feature: bounded by the level count
    pos = (corr.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= k)
           .withColumn("direction", F.lit("positive")))
    neg = (corr.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= k)
           .withColumn("direction", F.lit("negative")))
    return pos.unionByName(neg).select("direction", "rank", "feature", "correlation")
