"""Write PLANS.md: the executed (final adaptive) plan of every registered query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Each query is run once; its final plan is summarised (exchanges, joins,
windows, scans with their pushed filters and read schema). Reports whose
inputs were written by an earlier step show the plan after that cut.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str) -> dict:
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    return {
        "hash": ex.count("hashpartitioning"), "range": ex.count("rangepartitioning"),
        "single": ex.count("SinglePartition"),
        "bhj": plan.count("BroadcastHashJoin"), "smj": plan.count("SortMergeJoin"),
        "window": len(re.findall(r"\bWindow\b", plan)),
        "partial_agg": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from visitstat.session import build_session
    spark = build_session()
    print("# PLANS\n")
    print(f"Executed plans of the registered queries at `{sf_dir}` (local[*], 8 shuffle partitions),")
    print("generated by `tests/plan_report.py`. Counts are over the final adaptive plan of the")
    print("query's last step; earlier steps end in written tables (lineage cuts) and are not repeated.")
    print("`single` exchanges only ever carry partial-aggregate rows or bounded tables.\n")
    print("| query | hash exch. | range exch. | single | broadcast joins | sort-merge joins | windows | partial aggs |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    details = {}
    for name, fn in E.queries().items():
        df = fn(spark, sf_dir)
        df.collect()
        tree = df._jdf.queryExecution().executedPlan().toString()
        final = tree.split("+- == Initial Plan ==")[0]
        s = summary(final)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        print(f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['bhj']} | {s['smj']} | "
              f"{s['window']} | {s['partial_agg']} |")
        if name in ("daily_profile_trimmed", "segment_report", "shard_range", "segment_report_range",
                    "weekly_dynamics_range", "histogram_total_revenue"):
            details[name] = plan
    print("\n## Selected plans\n")
    for name, plan in details.items():
        scans = [l.strip() for l in plan.splitlines()
                 if l.strip().startswith(("PushedFilters", "PartitionFilters", "ReadSchema", "Location"))]
        head = plan.split("\n\n")[0]
        print(f"### {name}\n\n```\n{head}\n```\n")
        if scans:
            print("Scan details:\n\n```\n" + "\n".join(scans) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
