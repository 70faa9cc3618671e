"""Write PLANS.md: per registered query, the shuffles and broadcasts in its physical plan.

Usage: python tests/plan_report.py [sf_dir]   (plans are taken before execution)
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


NOTES = """
How to read it (scale notes, 100 TB / 1000 executors):

- Downstream queries scan the processed Parquet tables, e.g. `churn_rate_by_contract`: one
  partial-aggregated `hash` exchange plus a `range` exchange for the small sorted result, with
  the `IsNotNull` filter pushed to the scan.
- `single` exchanges only ever feed global aggregates (one row per task is shuffled) or the
  per-partition offset tables of the exact rank (one row per partition);
  `tests/test_scale_guard.py` enforces this for every SQL-checked query.
- One-row global statistics are scalar subqueries (`operators/scalars.py`), not joins, so they
  do not appear as `bcast` sides; `BNLJ` is 0 for every SQL-checked query (guarded by
  `tests/test_scale_guard.py`).
- `bcast` sides are level tables, fixed strategy/threshold tables, the 25-nation dimension and
  offset tables. On these tiny fixtures `customer` is broadcast too,
  but nothing forces it: Catalyst's size check and AQE pick sort-merge once it grows past the
  threshold.
- `ckpt` > 0 marks queries whose exact rank or materialised input was checkpointed to
  `spark.checkpoint.dir` before the final plan; their sorts and shuffles ran eagerly in those
  checkpoint jobs, so they do not appear in the counted plan.
- `python` is 0 everywhere: there are no Python UDFs; all expressions stay in whole-stage codegen.
"""


def summarize(plan: str) -> dict:
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": len(re.findall(r"BroadcastExchange", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "bnlj": len(re.findall(r"BroadcastNestedLoopJoin", plan)),
        "scans": sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan)), key=len)[:3],
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p)),
        "rdd": plan.count("Scan ExistingRDD"),
        "python": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", plan)),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    import __spark_entry__ as E
    from retentio.session import get_session
    spark = get_session()
    qs, ors = E.queries(), E.oracle_sql()
    lines = ["# Physical plan summary", "",
             f"Generated by `tests/plan_report.py` at `{sf_dir}` on local mode (Catalyst picks "
             "broadcast for small sides here; at scale the same plans switch to sort-merge by "
             "size). Counts are exchanges in the plan before execution; `ckpt` = scans of "
             "checkpointed data (exact ranks, processed tables read as Parquet are `FileScan`).",
             NOTES, "", "| query | check | hash | range | single | bcast | SMJ | BHJ | BNLJ | ckpt | python | pushed filters |",
             "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    for n in qs:
        try:
            df = qs[n](spark, sf_dir)
            s = summarize(df._jdf.queryExecution().executedPlan().toString())
            lines.append(f"| {n} | {'D' if n in ors else 'R'} | {s['hash']} | {s['range']} | "
                         f"{s['single']} | {s['bcast']} | {s['smj']} | {s['bhj']} | {s['bnlj']} | "
                         f"{s['rdd']} | {s['python']} | {'; '.join(s['pushed'])[:60]} |")
        except Exception as e:  # noqa: BLE001
            lines.append(f"| {n} | error: {type(e).__name__} |")
        print(lines[-1], flush=True)
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv)
