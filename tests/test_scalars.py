"""Global statistics as scalar subqueries; lookup without theta joins (brute force)."""

import re

import pytest
from pyspark.sql import functions as F

from retentio.operators.clean import lookup_customer
from retentio.operators.scalars import with_scalars


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_with_scalars_attaches_without_join(spark):
    df = spark.range(1, 101).withColumn("v", F.col("id") * 2)
    stats = df.agg(F.max("v").alias("mx"), F.min("v").alias("mn"))
    out = with_scalars(df, stats).select("id", (F.col("v") / F.col("mx")).alias("r"), "mn")
    rows = out.orderBy("id").collect()
    assert len(rows) == 100
    assert rows[0].r == pytest.approx(2 / 200) and rows[-1].r == 1.0
    assert {r.mn for r in rows} == {2}
    plan = _plan(out)
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert "Subquery" in plan


def test_with_scalars_rejects_multi_row_statistic(spark):
    df = spark.range(10)
    bad = spark.range(3).select(F.col("id").alias("s"))
    with pytest.raises(Exception):
        with_scalars(df, bad).collect()


IDS = ["0001-AAAA", "0002-AAAB", "0003-BBBB", "1000-ABAB", "7777-XYZQ", "7000-0000",
       "0000-0000", "0000-0001", "0000-0002"]
QUERIES = ["0003-bbbb", " 0002-AAAB ", "000", "aab", "zq", "b.b", "^7.*0$", "[xy]z", "nomatch",
           "x{2}", "0000-000", "0000-0000"]


def _brute(ids, queries):
    out = {}
    for q in set(queries):
        k = q.strip().lower()
        ex = sorted(i for i in ids if i.lower() == k)
        if ex:
            out[q] = (ex[0], "exact")
            continue
        if re.search(r"[\\^$.|?*+()\[\]{}]", k):
            hit = sorted(i for i in ids if re.search(k, i, re.I))
        else:
            hit = sorted(i for i in ids if k in i.lower())
        if hit:
            out[q] = (hit[0], "contains")
    return out


@pytest.mark.parametrize("block", [256, 1])
def test_lookup_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr("retentio.operators.clean.REGEX_BLOCK", block)
    subs = spark.createDataFrame([(i,) for i in IDS], "customerID string")
    qs = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    res = lookup_customer(subs, qs)
    got = {r.query: (r.customerID, r.match_type) for r in res.collect()}
    assert got == _brute(IDS, QUERIES)
    plan = _plan(res)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
