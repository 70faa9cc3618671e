"""Property tests for the distributed exact rank, running totals and quantiles."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from retentio.operators.rank import exact_rank, running_totals
from retentio.operators.selection import exact_quantiles


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_rank_is_permutation_with_heavy_ties(spark, parts):
    # one value holds a third of the rows
    rows = [(i, 0 if i % 3 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long")
    out = exact_rank(df, [F.col("v"), F.col("id")], num_partitions=parts).toPandas()
    assert sorted(out.rn) == list(range(1, 301))
    assert set(out.n_total) == {300}
    exp = sorted(rows, key=lambda r: (r[1], r[0]))
    got = out.sort_values("rn")[["id", "v"]].itertuples(index=False, name=None)
    assert list(got) == exp


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3)), min_size=1, max_size=60),
       st.integers(1, 6))
def test_running_totals_match_cumsum(spark, vals, parts):
    rows = [(i, a, b) for i, (a, b) in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, k long, w long")
    out = running_totals(df, [F.col("k").desc(), F.col("id")], {"w": "w"},
                         with_rank="r", num_partitions=parts).toPandas().sort_values("r")
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert out.cum_w.tolist() == list(np.cumsum([r[2] for r in exp]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=80))
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    q = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    exp = np.percentile(np.array(xs), [0, 25, 50, 75, 100])
    assert np.allclose([q.q0, q.q1, q.q2, q.q3, q.q4], exp, rtol=1e-12, atol=1e-9)
