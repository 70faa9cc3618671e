"""Exact global rank and running totals without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.  The
pattern here keeps the work distributed and exact for any key skew:

1. ``repartitionByRange`` on the *full* sort key (value plus a unique
   tie-breaker).  The range partitioner samples the composite key, so even a
   value held by a third of all rows is split across partitions by the
   tie-breaker;
2. ``sortWithinPartitions`` on the same key; each row gets its partition id and
   its position inside the partition (low 33 bits of
   ``monotonically_increasing_id``);
3. the result is checkpointed to ``spark.checkpoint.dir`` (reliable storage),
   which fixes the partition layout, cuts lineage and survives executor loss;
4. per-partition counts (one row per partition, a bounded table) get prefix
   sums and are broadcast back: ``rank = offset[pid] + position + 1``.

Running sums of weights follow the same layout; the within-partition running
sum is a window partitioned by the partition id (one balanced exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from retentio.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1
#: Estimated input bytes of a range partition.
RANK_PARTITION_BYTES = 128 << 20


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    spark = df.sparkSession
    # An explicit range partitioning is not resized by adaptive execution: follow the input's bytes.
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // RANK_PARTITION_BYTES, 1)


def input_bytes(df: DataFrame) -> int:
    """Estimated bytes of the tables that ``df`` reads; sources that Spark cannot size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def _sorted_layout(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    laid = (df.repartitionByRange(n, *order)
            .sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    return laid.checkpoint(eager=True)


def _offsets(laid: DataFrame, value_cols: dict[str, Column]) -> DataFrame:
    """One row per partition: exclusive prefix sums of count and values (bounded by #partitions)."""
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [F.sum(c).alias(f"_tot_{k}")
                                                for k, c in value_cols.items()]
    per = laid.groupBy("_pid").agg(*aggs)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding,
                                              Window.unboundedFollowing)
    out = per.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off_cnt"),
        F.sum("_cnt").over(wall).alias("_n_total"),
        *[F.coalesce(F.sum(f"_tot_{k}").over(w), F.lit(0)).alias(f"_off_{k}")
          for k in value_cols],
        *[F.sum(f"_tot_{k}").over(wall).alias(f"_all_{k}") for k in value_cols],
    )
    return out


def exact_rank(df: DataFrame, order: list[Column | str], rank_col: str = "rn",
               total_col: str | None = "n_total",
               num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based exact rank for a *total* order (include a unique tie-breaker).

    Equals ``row_number() over (order by ...)`` but never puts all rows in one
    task.  ``total_col`` (optional) carries the row count for quantile formulas.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = _sorted_layout(df, order, num_partitions)
    offs = _offsets(laid, {})
    out = (laid.join(F.broadcast(offs), "_pid")
           .withColumn(rank_col, F.col("_off_cnt") + F.col("_pos") + 1))
    keep = [c for c in df.columns] + [rank_col]
    if total_col:
        out = out.withColumn(total_col, F.col("_n_total"))
        keep.append(total_col)
    return out.select(*keep)


def running_totals(df: DataFrame, order: list[Column | str], values: dict[str, Column | str],
                   inclusive: bool = True, with_rank: str | None = None,
                   with_grand_totals: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<name>`` running sums of ``values`` in ``order`` (total order required).

    ``with_grand_totals`` adds ``all_<name>`` (the column totals) for normalising.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    vals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    base = df.select("*", *[v.alias(f"_v_{k}") for k, v in vals.items()])
    laid = _sorted_layout(base, order, num_partitions)
    offs = _offsets(laid, {k: F.col(f"_v_{k}") for k in vals})
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    wp = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(*frame)
    j = laid.join(F.broadcast(offs), "_pid")
    cols = list(df.columns)
    extra = []
    for k in vals:
        extra.append((F.col(f"_off_{k}") + F.coalesce(F.sum(f"_v_{k}").over(wp), F.lit(0)))
                     .alias(f"cum_{k}"))
        if with_grand_totals:
            extra.append(F.col(f"_all_{k}").alias(f"all_{k}"))
    if with_rank:
        extra.append((F.col("_off_cnt") + F.col("_pos") + 1).alias(with_rank))
    return j.select(*cols, *extra)
