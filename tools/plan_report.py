"""Print the physical-plan shape of the registered queries.

usage: python tools/plan_report.py [sf_dir] [--no-broadcast]

With --no-broadcast, spark.sql.autoBroadcastJoinThreshold is -1, which shows
the plans Spark picks when the joined tables are too large to broadcast (the
100 TB shape).  Per query: hash/range/single exchanges, broadcasts, window
group limits, partial aggregates, and the filters pushed into the scans.
"""

import re
import sys

sys.path.insert(0, ".")
from carelens.plans.catalog import QUERIES  # noqa: E402
from carelens.session import local_session  # noqa: E402

MODEL = {"anomaly_scores", "trust_scores", "trust_metrics", "shap_local", "shap_global",
         "reviewed", "recent_runs"}


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    if "--no-broadcast" in sys.argv:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print("| query | hash exch. | range exch. | single exch. | broadcasts | window group limits | hash aggregates | sort-merge joins | pushed scan filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name in MODEL or args[1:] and name not in args[1:]:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        pushed = sorted(set(p.rstrip("]") for p in re.findall(r"PushedFilters: \[(.*?), ReadSchema", plan)) - {""})
        print(f"| {name} | {plan.count('Exchange hashpartitioning')} | "
              f"{plan.count('Exchange rangepartitioning')} | {plan.count('Exchange SinglePartition')} | "
              f"{plan.count('BroadcastExchange')} | {plan.count('WindowGroupLimit')} | "
              f"{plan.count('HashAggregate(')} | "
              f"{plan.count('SortMergeJoin')} | {'; '.join(p[:60] for p in pushed)[:120]} |")


if __name__ == "__main__":
    main()
