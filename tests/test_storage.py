"""Rounding ties against pandas, hot values in quantiles, and stored tables that follow their sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentio.functions.expr import half_even_quotient, pct_1dp
from retentio.operators.explain import as_arrays, attribution_reasons, top_attributions
from retentio.operators.rank import input_bytes
from retentio.operators.selection import exact_quantiles
from retentio.session import ensure_checkpoint_dir
from retentio.sources.processed import fingerprint, processed


def test_percentages_round_like_pandas(spark):
    cases = [(1, 16), (3, 16), (1, 80), (5, 16), (7, 80), (0, 3), (2, 3), (1, 3), (9, 9), (1, 0)]
    df = spark.createDataFrame(cases, "a long, b long")
    got = [r[0] for r in df.select(pct_1dp("a", "b")).collect()]
    want = [(pd.Series([a / b]) * 100).round(1)[0] if b else None for a, b in cases]
    assert got == want and got[:3] == [6.2, 18.8, 1.2]
    whole = [r[0] for r in df.select(half_even_quotient(F.col("a") * 100, F.col("b"))).collect()]
    assert whole == [int(np.round(100 * a / b)) if b else None for a, b in cases]


def test_quantiles_of_a_hot_value(spark):
    values = [7.0] * 8000 + [float(i) for i in range(2000)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int").repartition(8)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    row = exact_quantiles(df, "v", probs).first()
    assert [row[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(values, probs))
    for r in exact_quantiles(df, "v", probs, by="g").collect():
        own = [v for i, v in enumerate(values) if i % 2 == r["g"]]
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(own, probs))


def test_unsized_sources_count_as_nothing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert input_bytes(spark.createDataFrame(df.rdd, df.schema)) < 1 << 60


def test_stored_tables_follow_their_source(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    source = f"{tmp_path}/orders.parquet"
    spark.range(5).write.parquet(source)
    read = lambda: processed(spark, f"file://{tmp_path}", "probe", lambda: spark.read.parquet(source), ("orders",))
    assert read().count() == 5
    before = fingerprint(spark, f"file://{tmp_path}", ["orders"])
    spark.range(3).write.mode("append").parquet(source)
    assert fingerprint(spark, f"file://{tmp_path}", ["orders"]) != before
    assert read().count() == 8


def test_attributions_long_and_by_customer(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", f"f{j}", 1.0, float(rng.normal())) for i in range(4) for j in range(20)]
    long = spark.createDataFrame(rows, "customerID string, feature string, value double, shap double")
    arrays = as_arrays(long)
    assert "Exchange" not in top_attributions(arrays.select("*"))._jdf.queryExecution().optimizedPlan().toString()
    a, b = (sorted(map(tuple, top_attributions(x).collect())) for x in (long, arrays))
    assert a == b and len(a) == 4 * 12
    for i in range(4):
        own = sorted((r for r in rows if r[0] == f"c{i}"), key=lambda r: (-abs(r[3]), r[1]))[:12]
        want = [r[1] for r in sorted(own, key=lambda r: (r[3], r[1]))]
        assert [r[1] for r in sorted((x for x in a if x[0] == f"c{i}"), key=lambda x: x[4])] == want
        up = sorted((r for r in own if r[3] > 0), key=lambda r: -r[3])[:3]
        down = sorted((r for r in own if r[3] < 0), key=lambda r: r[3])[:2]
        got = [(r["direction"], r["rank"], r["feature"]) for r in attribution_reasons(arrays).filter(F.col("customerID") == f"c{i}").collect()]
        assert sorted(got) == sorted([("increases risk", k + 1, r[1]) for k, r in enumerate(up)]
                                     + [("reduces risk", k + 1, r[1]) for k, r in enumerate(down)])
