"""Exact order statistics without a sort: a sample bounds each cut, a counting pass narrows it.

``order_statistics`` finds the rows at given ranks of any total preorder (a value, or a value and
an id). All cuts share every pass over one slim, persisted projection of the input:

1. count the rows;
2. sample each open interval evenly, in the tasks; two sample keys around a rank bound it;
3. count the rows below and up to these bounds. If the rank is one of a bound's own rows, it is
   found (a value that many rows share is found so); otherwise the part between or beyond the bounds that
   holds it is the new interval. A bad sample costs a pass but never a wrong result;
4. repeat until an interval holds at most ``SAMPLE_ROWS`` rows: then all of them are sampled and
   the answer is picked.

Each turn divides the rows of an interval by about 15, so 10^10 rows take six turns. Nothing is sorted or
checkpointed, and the driver gets at most about ``SAMPLE_ROWS`` keys for each interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

#: Keys that an interval's sample aims at.
SAMPLE_ROWS = 20_000
#: Standard deviations between a rank's place in the sample and its bounds.
MARGIN = 4.0
#: Every turn leaves a part of each interval; so many are never needed.
MOST_TURNS = 200
Key = tuple


def sort_key(key: Key):
    """Python order equal to Spark's: null, numbers (NaN last), text by code point."""
    return tuple((0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v) for v in key)


@dataclass
class _Interval:
    """Rows after ``below`` others, ``size`` of them; bounds are (key, inclusive) or None."""
    below: int
    size: int
    low: tuple[Key, bool] | None = None
    high: tuple[Key, bool] | None = None

    def holds(self, key: Column, literal: Callable[[Key], Column]) -> Column:
        inside = key.isNotNull()
        if self.low:
            k, closed = self.low
            inside = inside & ((key >= literal(k)) if closed else (key > literal(k)))
        if self.high:
            k, closed = self.high
            inside = inside & ((key <= literal(k)) if closed else (key < literal(k)))
        return inside

    def name(self):
        return repr((self.below, self.size, self.low, self.high))


@dataclass
class Selection:
    """Counts by name, and the key at each (name, rank)."""
    counts: dict[str, int]
    keys: dict[str, dict[int, Key]]


def order_statistics(df: DataFrame, keys: dict[str, Sequence[Column]], ranks: dict[str, Callable[[int], Sequence[int]]],
                     where: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7,
                     partitions: int | None = None) -> Selection:
    """The keys at the ranks (1-based, ascending, nulls first) that ``ranks`` gives for each name's row count.

    ``where`` leaves rows out for a name. Ranks outside 1..n are ignored. The number of cuts should
    be small: each is a condition in one aggregate. ``partitions`` deals the slim projection anew (default: as the input lies).
    """
    where = where or {}
    struct = lambda name: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys[name])])
    spelled = {n: f"_k{i}" for i, n in enumerate(keys)}
    keyed = df.select(*[(F.when(where[n], struct(n)) if n in where else struct(n)).alias(s) for n, s in spelled.items()])
    if partitions:
        keyed = keyed.repartition(partitions)
    keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    first = keyed.agg(*[F.count(s).alias(s) for s in spelled.values()])
    try:
        row = first.first()
        out = Selection({n: row[s] for n, s in spelled.items()}, {n: {} for n in keys})
        kinds = {n: [f.dataType for f in keyed.schema[s].dataType.fields] for n, s in spelled.items()}

        def literal(name: str) -> Callable[[Key], Column]:
            return lambda key: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(key, kinds[name]))])

        open_cuts = {(n, r): _Interval(0, out.counts[n]) for n in keys for r in sorted(set(ranks[n](out.counts[n])))
                     if 1 <= r <= out.counts[n]}
        turn = 0
        while open_cuts:
            turn += 1
            if turn > MOST_TURNS:
                raise RuntimeError(f"{len(open_cuts)} cuts are not found after {MOST_TURNS} turns")
            samples = _samples(keyed, spelled, open_cuts, literal, sample_rows, seed + turn)
            bounds = {}
            for (n, r), span in list(open_cuts.items()):
                sample = samples[n, span.name()]
                if span.size <= sample_rows:
                    out.keys[n][r] = sample[r - span.below - 1]
                    del open_cuts[n, r]
                    continue
                share = (r - span.below) / span.size
                # A small sample must still cut its interval; a wrong cut is found by the counts.
                margin = min(MARGIN * math.sqrt(len(sample) * share * (1 - share)) + 2, 1 + len(sample) / 8)
                i, j = math.floor(len(sample) * share - margin), math.ceil(len(sample) * share + margin)
                bounds[n, r] = sample[i] if 0 <= i < len(sample) else None, sample[j] if 0 <= j < len(sample) else None
            if bounds:
                _narrow(keyed, spelled, open_cuts, bounds, literal, out)
        return out
    finally:
        keyed.unpersist()


def _samples(keyed, spelled, open_cuts, literal, sample_rows, seed) -> dict:
    """Sorted sample keys of every open interval; all keys where it holds at most ``sample_rows``."""
    spans = {(n, span.name()): span for (n, _), span in open_cuts.items()}
    drawn = []
    for i, ((n, _), span) in enumerate(spans.items()):
        key = F.col(spelled[n])
        inside = span.holds(key, literal(n))
        if span.size > sample_rows:
            inside = inside & (F.col("_u") < sample_rows / span.size)
        drawn.append(F.collect_list(F.when(inside, key)).alias(f"s{i}"))
    row = keyed.withColumn("_u", F.rand(seed)).agg(*drawn).first()
    return {k: sorted((tuple(x) for x in row[i]), key=sort_key) for i, k in enumerate(spans)}


def _narrow(keyed, spelled, open_cuts, bounds, literal, out) -> None:
    """Count the rows before and up to each cut's bounds; the rank is at a bound, between them or beyond one."""
    counts = []
    for i, ((n, _), pair) in enumerate(bounds.items()):
        key = F.col(spelled[n])
        for side, bound in zip("lh", pair):
            if bound is not None:
                counts += [F.count_if(key < literal(n)(bound)).alias(f"{side}{i}"), F.count_if(key <= literal(n)(bound)).alias(f"{side}{i}_")]
    if not counts:
        return
    row = keyed.agg(*counts).first()
    for i, ((n, r), (low, high)) in enumerate(bounds.items()):
        span = open_cuts[n, r]
        start, end = span.below, span.below + span.size
        for bound, side in ((low, "l"), (high, "h")):
            if bound is None:
                continue
            before, upto = row[f"{side}{i}"], row[f"{side}{i}_"]
            if before < r <= upto:
                out.keys[n][r] = bound
                del open_cuts[n, r]
                break
            if r <= before:
                if before < end:
                    span.high, end = (bound, False), before
            elif upto > start:
                span.low, start = (bound, False), upto
        else:
            open_cuts[n, r] = _Interval(start, end - start, span.low, span.high)


def quantile_ranks(n: int, probs: Sequence[float]) -> list[int]:
    """The ranks that linear interpolation at ``probs`` reads."""
    return [1 + f((n - 1) * p) for p in probs for f in (math.floor, math.ceil)] if n else []


def interpolate(n: int, at: Callable[[int], float], probs: Sequence[float]) -> list[float | None]:
    """Linear quantiles (as numpy and pandas) from order statistics."""
    out = []
    for p in probs:
        h = (n - 1) * float(p)
        lo, hi = (at(1 + f(h)) for f in (math.floor, math.ceil)) if n else (None, None)
        out.append(None if lo is None else lo + (h - math.floor(h)) * (hi - lo))
    return out


def exact_quantiles_of(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear quantiles of several numeric columns from the same passes; nulls are ignored."""
    values = {c: F.col(f"`{c}`").cast("double") for c in columns}
    found = order_statistics(df, {c: [v] for c, v in values.items()}, {c: lambda n: quantile_ranks(n, probs) for c in columns},
                             where={c: v.isNotNull() for c, v in values.items()})
    return {c: interpolate(found.counts[c], lambda r, c=c: found.keys[c][r][0], probs) for c in columns}


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | None = None) -> DataFrame:
    """Exact linear quantiles per group as one row each: (``by``), ``n``, ``q0``..

    Groups are classes: their counts are collected, and each adds two cuts for a probability. Null values are ignored.
    """
    x = F.col(value).cast("double")
    rows = df.select(*([F.col(by)] if by else []), x.alias("_x")).filter(F.col("_x").isNotNull())
    outs = ", ".join(["n long", *[f"q{i} double" for i in range(len(probs))]])
    spark = df.sparkSession
    if not by:
        found = order_statistics(rows, {"x": [F.col("_x")]}, {"x": lambda n: quantile_ranks(n, probs)})
        n = found.counts["x"]
        made = [(n, *interpolate(n, lambda r: found.keys["x"][r][0], probs))] if n else []
        return spark.createDataFrame(made, outs)
    kind = df.schema[by].dataType.simpleString()
    groups = sorted(((r[0], r[1]) for r in rows.groupBy(by).count().collect()), key=lambda g: sort_key((g[0],)))
    starts, total = [], 0
    for _, n in groups:
        starts.append(total)
        total += n
    found = order_statistics(rows, {"x": [F.col(by), F.col("_x")]},
                             {"x": lambda _: [s + r for (_, n), s in zip(groups, starts) for r in quantile_ranks(n, probs)]})
    made = [(g, n, *interpolate(n, lambda r, s=s: found.keys["x"][s + r][1], probs)) for (g, n), s in zip(groups, starts)]
    return spark.createDataFrame(made, f"`{by}` {kind}, {outs}")
