"""Feature engineering (F1-F11) and RFM scoring.

Global statistics of the proxies and moments are one-row aggregates attached as scalar
subqueries (``operators.scalars``; no join).  Quintiles need a few order statistics, which
``operators.selection`` finds without a sort; ties are broken by ``customerID`` ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retentio.functions.expr import (SERVICE_COLUMNS, charges_per_month, engagement_score,
                                     quintile_from_edges, segment_label,
                                     tenure_group)
from retentio.operators.clean import string_columns
from retentio.operators.scalars import with_scalars
from retentio.operators.selection import interpolate, order_statistics, quantile_ranks

_QUINTILES = [0.2, 0.4, 0.6, 0.8]


def add_tenure_group(df: DataFrame, tenure: str = "tenure") -> DataFrame:
    """F1."""
    return df.withColumn("tenure_group", tenure_group(tenure))


def add_engagement(df: DataFrame, services: list[str] | None = None) -> DataFrame:
    """count of 'Yes' over the service columns present in ``df``."""
    cols = [c for c in (services or SERVICE_COLUMNS) if c in df.columns]
    return df.withColumn("engagement_score", engagement_score(cols))


def add_charges_per_month(df: DataFrame) -> DataFrame:
    """F3."""
    return df.withColumn("charges_per_month", charges_per_month())


def add_rfm_proxies(df: DataFrame, tenure: str = "tenure") -> DataFrame:
    """recency = max(tenure) - tenure, frequency = engagement, monetary = TotalCharges."""
    if "engagement_score" not in df.columns:
        df = add_engagement(df)
    mx = df.agg(F.max(tenure).alias("_max_tenure"))
    return (with_scalars(df, mx)
            .withColumn("recency", (F.col("_max_tenure") - F.col(tenure)).cast("int"))
            .withColumn("frequency", F.col("engagement_score"))
            .withColumn("monetary", F.col("TotalCharges"))
            .drop("_max_tenure"))


def _edges(n: int, at) -> list[float | None]:
    """Smallest value and 20/40/60/80 % quantiles (linear) from order statistics."""
    return interpolate(n, at, [0.0, *_QUINTILES])


def _label_ends(n: int) -> list[int]:
    """Ranks that close the lower four of five classes of ``qcut(rank, 5)``: class k ends at 1 + k (n - 1) div 5."""
    return [1 + k * (n - 1) // 5 for k in range(1, 5)] if n else []


def _r_score(col: str, edges: list[float | None]) -> Column:
    return quintile_from_edges(col, [F.lit(e).cast("double") for e in edges], reverse=True).cast("int")


def _rank_label(df: DataFrame, value: str, id_col: str, cuts: list[tuple]) -> Column:
    """One more than the cuts that stand before the row in the order (value, id), nulls first."""
    own = F.struct(F.col(value).alias("v"), F.col(id_col).alias("i"))
    kinds = df.schema[value].dataType, df.schema[id_col].dataType
    label = F.lit(1)
    for v, i in cuts:
        label = label + F.when(own > F.struct(F.lit(v).cast(kinds[0]).alias("v"), F.lit(i).cast(kinds[1]).alias("i")), 1).otherwise(0)
    return label.cast("int")


def add_r_score(df: DataFrame, col: str = "recency") -> DataFrame:
    """``qcut(recency, 5, labels=[5..1])``; the edges are exact order statistics of any numeric column."""
    found = order_statistics(df, {"r": [F.col(col).cast("double")]}, {"r": lambda n: quantile_ranks(n, [0.0, *_QUINTILES])},
                             where={"r": F.col(col).isNotNull()})
    return df.withColumn("R_Score", _r_score(col, _edges(found.counts["r"], lambda r: found.keys["r"][r][0])))


def add_rank_quintile(df: DataFrame, value: str, out: str, id_col: str = "customerID",
                      num_partitions: int | None = None) -> DataFrame:
    """``qcut(value.rank(method='first'), 5)`` -> 1..5, exact at any scale.

    The rows that close the lower quintiles are selected, not ranked; a row's label is one
    more than the cuts that stand before it.
    """
    found = order_statistics(df, {"v": [F.col(value), F.col(id_col)]}, {"v": _label_ends}, partitions=num_partitions)
    return df.withColumn(out, _rank_label(df, value, id_col, [found.keys["v"][r] for r in _label_ends(found.counts["v"])]))


def _with_scores(df: DataFrame, edges: list[float | None], cuts: dict[str, list[tuple]], id_col: str) -> DataFrame:
    return (df.withColumn("R_Score", _r_score("recency", edges))
            .withColumn("F_Score", _rank_label(df, "frequency", id_col, cuts["frequency"]))
            .withColumn("M_Score", _rank_label(df, "monetary", id_col, cuts["monetary"]))
            .withColumn("RFM_Score", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))
            .withColumn("RFM_Segment", segment_label("RFM_Score")))


def add_rfm_scores(df: DataFrame, id_col: str = "customerID",
                   num_partitions: int | None = None) -> DataFrame:
    """W1-W3 + F5: R/F/M scores, their sum and the segment label; all cuts come from the same passes."""
    found = order_statistics(
        df, {"recency": [F.col("recency").cast("double")], **{c: [F.col(c), F.col(id_col)] for c in ("frequency", "monetary")}},
        {"recency": lambda n: quantile_ranks(n, [0.0, *_QUINTILES]), "frequency": _label_ends, "monetary": _label_ends},
        where={"recency": F.col("recency").isNotNull()}, partitions=num_partitions)
    edges = _edges(found.counts["recency"], lambda r: found.keys["recency"][r][0])
    cuts = {c: [found.keys[c][r] for r in _label_ends(found.counts[c])] for c in ("frequency", "monetary")}
    return _with_scores(df, edges, cuts, id_col)


def all_features(df: DataFrame, num_partitions: int | None = None, id_col: str = "customerID") -> DataFrame:
    """F1 -> F2 -> F3 -> F4 -> W1-W3 -> F5.

    ``df`` is read once for the maximum and all cuts (a slim projection is kept), and once for the rows.
    """
    out = add_charges_per_month(add_engagement(add_tenure_group(df)))
    # Recency is the largest tenure minus tenure: its quantiles are tenure's, read from the other end.
    mirrored = lambda n: [n + 1 - r for r in quantile_ranks(n, [0.0, *_QUINTILES])]
    names = {"frequency": "engagement_score", "monetary": "TotalCharges"}
    found = order_statistics(
        out, {"tenure": [F.col("tenure")], **{k: [F.col(c), F.col(id_col)] for k, c in names.items()}},
        {"tenure": lambda n: [n, *mirrored(n)], "frequency": _label_ends, "monetary": _label_ends},
        where={"tenure": F.col("tenure").isNotNull()}, partitions=num_partitions)
    n, tenure = found.counts["tenure"], found.keys["tenure"]
    longest = tenure[n][0] if n else None
    proxies = (out.withColumn("recency", (F.lit(longest).cast(df.schema["tenure"].dataType) - F.col("tenure")).cast("int"))
               .withColumn("frequency", F.col("engagement_score")).withColumn("monetary", F.col("TotalCharges")))
    edges = _edges(n, lambda r: float(longest - tenure[n + 1 - r][0]))
    cuts = {k: [found.keys[k][r] for r in _label_ends(found.counts[k])] for k in names}
    return _with_scores(proxies, edges, cuts, id_col)


# ---------------------------------------------------------------- encoding

#: Levels that ``categorical_levels`` returns for all columns together, at most.
MAX_LEVELS = 20_000


def categorical_levels(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Distinct levels per column (sorted, NULL excluded) in one aggregation pass.

    The caller names the categorical columns (``categorical_columns`` leaves ids out). One output
    column per level is what the encoding means, so more than ``max_levels`` levels, which no frame
    holds as columns, are an error that names the widest column; no level is left out.
    """
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cols)])
    # Each task passes on its distinct pairs; a column's levels never meet in one aggregation buffer.
    levels = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
    rows = levels.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        widest = levels.groupBy("i").count().orderBy(F.col("count").desc(), "i").first()
        raise ValueError(f"{cols[widest['i']]} has {widest['count']} levels; at most {max_levels} become columns")
    found: dict[str, list] = {c: [] for c in cols}
    for i, v in sorted(map(tuple, rows)):
        found[cols[i]].append(v)
    return found


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = False,
            keep_original: bool = False) -> DataFrame:
    """``{col}_{level}`` 0/1 columns over frozen levels.

    Unseen or NULL values give all zeros; ``drop_first`` drops the
    alphabetically first level (pandas ``drop_first=True``).
    """
    out_cols = []
    for c in df.columns:
        if c in levels:
            lv = levels[c][1:] if drop_first else levels[c]
            out_cols += [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                         .alias(f"{c}_{v}") for v in lv]
            if keep_original:
                out_cols.append(F.col(c))
        else:
            out_cols.append(F.col(c))
    return df.select(*out_cols)


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ("customerID",)) -> list[str]:
    return [c for c in string_columns(df) if c not in exclude]


def one_hot_all(df: DataFrame, exclude: tuple[str, ...] = ("customerID",)) -> DataFrame:
    """one-hot of every string column (all levels), pandas column naming."""
    cols = categorical_columns(df, exclude)
    return one_hot(df, categorical_levels(df, cols), drop_first=False)


def one_hot_drop_first(df: DataFrame, exclude: tuple[str, ...] = ("customerID",)) -> DataFrame:
    """F8: as F7 without the alphabetically first level of each column."""
    cols = categorical_columns(df, exclude)
    return one_hot(df, categorical_levels(df, cols), drop_first=True)


def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population sd (sd 0 -> 1), as sklearn StandardScaler.

    The per-column moments are one aggregate row, attached as a scalar subquery.
    """
    stats = df.agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(cols)])
    out = with_scalars(df, stats)
    for i, c in enumerate(cols):
        sd = F.when(F.col(f"_s_{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{i}"))
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_m_{i}")) / sd)
    return out.drop(*[f"_m_{i}" for i in range(len(cols))],
                    *[f"_s_{i}" for i in range(len(cols))])


def convert_currency(df: DataFrame, cols: list[str], rate: float = 83.0,
                     suffix: str = "_inr") -> DataFrame:
    """money columns times an exchange rate."""
    return df.select("*", *[(F.col(c) * F.lit(float(rate))).alias(c + suffix) for c in cols])
