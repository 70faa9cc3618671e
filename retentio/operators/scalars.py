"""Attach global statistics to every row without a join.

A global statistic (max tenure, quantile edges, column moments, class totals)
is a one-row aggregate.  It is bound as one uncorrelated scalar subquery
holding a struct: Spark runs the aggregate once (partial aggregates per task,
one single-partition merge of per-task rows), inlines the single row into the
projection, and the main plan keeps its partitioning: no cross join, no
broadcast exchange, no change to the row count.  A statistic that returned
more than one row would fail the query instead of multiplying rows, so the
one-row bound is checked at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SLOT = "__scalars"


def scalar_struct(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct-valued scalar subquery."""
    return stats.select(F.struct(*[stats[c] for c in stats.columns]).alias(_SLOT)).scalar()


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` plus the columns of the one-row table ``stats`` on every row.

    The struct is bound once as a column and then expanded, so several fields
    share one subquery evaluation.
    """
    names = stats.columns
    return (df.withColumn(_SLOT, scalar_struct(stats))
            .select("*", *[F.col(_SLOT)[c].alias(c) for c in names])
            .drop(_SLOT))


__all__ = ["scalar_struct", "with_scalars"]
