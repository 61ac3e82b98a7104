"""Summarize the physical plans of the headline queries (markdown on stdout).

usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from flowwatch.session import build_session  # noqa: E402

KEYS = ["normalise_counts", "ledger", "ledger_conflicts", "rule_window_final", "rule_first_crossing",
        "late_events", "graph_edges", "graph_edge_versions", "circular_flow", "alerts", "evaluation_metrics"]
OPS = ["WindowGroupLimit", "Window", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
       "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "Generate", "ArrowEvalPython", "BatchEvalPython", "InMemoryTableScan"]


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    qs = E.queries()
    print(f"| query | exchanges (hash keys) | operators | scans (ReadSchema) |")
    print("| --- | --- | --- | --- |")
    for k in KEYS:
        df = qs[k](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        formatted = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        keys = re.findall(r"hashpartitioning\((.*?), \d+\)", formatted)
        keys = [re.sub(r"#\d+L?", "", x) for x in keys]
        ops = {op: len(re.findall(rf"\b{op}\b", plan)) for op in OPS}
        ops = ", ".join(f"{op}×{n}" for op, n in ops.items() if n)
        scans = re.findall(r"ReadSchema: struct<(.*?)>", formatted)
        widest = max((s.count(":") for s in scans), default=0)
        print(f"| `{k}` | {len(keys)}: " + "; ".join(f"`{x}`" for x in sorted(set(keys))) +
              f" | {ops} | {len(scans)} scans, widest {widest} columns |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
