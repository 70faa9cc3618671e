"""Order statistics without a sort, against sorting: many turns, ties, nulls, NaN, text and hot values."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from retentio.operators import features as FE
from retentio.operators import selection as S


def ranks_of(n):
    return [1, n // 3, 4 * n // 5, n, n + 1, 0]


@pytest.mark.parametrize("sample_rows", [200, 20_000])
def test_keys_of_all_kinds(spark, sample_rows):
    chance = random.Random(4)
    values = [None, float("nan"), -0.0, 0.0, 1.5, 1e300, -2.25]
    rows = []
    for i in range(900):
        # A value held by a third of the rows, repeated rows, and ids beyond ASCII.
        v = 3.0 if i % 3 == 0 else chance.choice(values)
        rows.append((v, chance.choice(["a", "é", "zz", "", None, f"id{i}"]), Decimal(chance.randrange(-50, 50)) / 4, i % 5))
    df = spark.createDataFrame(rows, "v double, s string, d decimal(10,2), g int").repartition(6)
    keys = {"pair": [F.col("v"), F.col("s")], "text": [F.col("s")], "dec": [F.col("d")], "some": [F.col("v")]}
    found = S.order_statistics(df, keys, {k: ranks_of for k in keys}, where={"some": F.col("g") < 2}, sample_rows=sample_rows)
    want = {"pair": [(r[0], r[1]) for r in rows], "text": [(r[1],) for r in rows], "dec": [(r[2],) for r in rows],
            "some": [(r[0],) for r in rows if r[3] < 2]}
    for name, all_keys in want.items():
        ordered = sorted(all_keys, key=S.sort_key)
        assert found.counts[name] == len(ordered)
        valid = [r for r in ranks_of(len(ordered)) if 1 <= r <= len(ordered)]
        assert sorted(found.keys[name]) == sorted(valid)
        for r in valid:
            assert S.sort_key(found.keys[name][r]) == S.sort_key(ordered[r - 1])


def test_python_order_is_sparks(spark):
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 2.5, -1e-300]
    df = spark.createDataFrame([(v, s) for v in values for s in (None, "", "a", "B", "é", "\U0001f600", "\uffee")], "v double, s string")
    got = [tuple(r) for r in df.orderBy("v", "s").collect()]
    assert [S.sort_key(r) for r in got] == sorted(S.sort_key(r) for r in got)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "v double, g string")
    assert S.order_statistics(df, {"v": [F.col("v")]}, {"v": lambda n: [1, n]}).keys == {"v": {}}
    assert S.exact_quantiles_of(df, ["v"], [0.5]) == {"v": [None]}
    assert S.exact_quantiles(df, "v", [0.5]).count() == 0 and S.exact_quantiles(df, "v", [0.5], by="g").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "v double, g string")
    assert S.exact_quantiles_of(nulls, ["v"], [0.5]) == {"v": [None]}
    assert S.order_statistics(nulls, {"v": [F.col("v")]}, {"v": lambda n: [n]}).keys == {"v": {2: (None,)}}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200), st.sampled_from([100, 1000]))
def test_quantiles_equal_numpy(spark, xs, sample_rows):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]
    n = len(xs)
    found = S.order_statistics(df, {"x": [F.col("x")]}, {"x": lambda n: S.quantile_ranks(n, probs)}, sample_rows=sample_rows)
    got = S.interpolate(n, lambda r: found.keys["x"][r][0], probs)
    assert np.allclose(got, np.quantile(xs, probs), rtol=1e-12, atol=1e-9)


def test_input_is_read_once(spark, tmp_path):
    # All cuts of a table come from one scan of it: the projection that is kept holds everything.
    spark.range(3000).select((F.col("id") % 97).alias("a"), F.md5(F.col("id").cast("string")).alias("b")).write.parquet(f"{tmp_path}/t")
    read = spark.sparkContext._jvm.java.util.concurrent.atomic.AtomicLong
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    df = spark.read.parquet(f"{tmp_path}/t").mapInArrow(count, "a long, b string")
    found = S.order_statistics(df, {"x": [F.col("a"), F.col("b")], "y": [F.col("b")]}, {k: lambda n: [1, n // 2, n] for k in "xy"}, sample_rows=500)
    assert reads.value == 3000
    rows = sorted((r["a"], r["b"]) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert found.keys["x"] == {r: rows[r - 1] for r in (1, 1500, 3000)}


def test_rank_quintiles_equal_pandas_rule(spark):
    for n in (1, 2, 7, 43):
        df = spark.createDataFrame([(i % 4, f"c{i:03d}") for i in range(n)], "frequency long, customerID string")
        got = {r["customerID"]: r["F_Score"] for r in FE.add_rank_quintile(df, "frequency", "F_Score").collect()}
        order = sorted((i % 4, f"c{i:03d}") for i in range(n))
        want = {c: 1 if n == 1 else max(1, math.ceil(5 * k / (n - 1))) for k, (_, c) in enumerate(order)}
        assert got == want
