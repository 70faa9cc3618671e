"""Scale guard: no single-partition exchange over row-level data in any registered plan.

A ``SinglePartition`` exchange is allowed only when the operator feeding it is
an aggregate (a global aggregate's partial rows, or a per-partition count
table) or a small local table; a row-level window without ``partitionBy``
would show a ``SinglePartition`` exchange over a scan or projection instead.
"""

import pytest

SF = "/root/testdata/sf0.001"
MODEL_FREE = None


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _violations(plan: str):
    lines = plan.splitlines()
    bad = []
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" not in ln:
            continue
        depth = len(ln) - len(ln.lstrip(" :+-"))
        for nxt in lines[i + 1:]:
            d = len(nxt) - len(nxt.lstrip(" :+-"))
            if d <= depth:
                break
            op = nxt.strip(" :+-")
            if any(op.startswith(k) for k in ("HashAggregate", "ObjectHashAggregate",
                                                "SortAggregate", "LocalTableScan")):
                break
            if op.startswith(("Scan", "FileScan", "Range", "InMemoryTableScan", "Exchange",
                              "BroadcastExchange", "Window",
                              "BroadcastHashJoin", "SortMergeJoin")):
                bad.append(ln.strip() + " <- " + op[:80])
                break
    return bad


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_no_single_partition_over_rows(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    assert _violations(_plan(df)) == []


@pytest.mark.parametrize("name", _names())
def test_no_cross_or_nested_loop_join(spark, name):
    """Global statistics are scalar subqueries and lookups equi-joins: no row pairs."""
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_guard_catches_unpartitioned_window(spark):
    from pyspark.sql import Window, functions as F
    df = spark.range(100).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert _violations(_plan(df))
