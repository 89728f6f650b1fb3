"""Print plan facts for registered queries: exchanges, join strategies, window
group limits, Python stages, pushed filters and read schemas.

usage: python scripts/explain_plans.py [sf_dir] [name-substring ...]

Queries whose builders run jobs while building (iterative graph, model fits,
exact quantiles) are skipped: their plans are per pass, not one plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkeda.plans import catalog  # noqa: E402
from sparkeda.session import get_spark  # noqa: E402

MARKERS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
           "WindowGroupLimit", "Window", "Expand", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "Generate"]
SKIP_PREFIXES = ("m7_", "m8_", "m9_", "m12_", "m17_", "m18_", "m20_", "m21_", "m22_", "g2_", "g3_page_chain",
                 "a1_", "a6_", "a9_", "n1_impute_median", "n6_", "m1_", "m3_", "m4_", "m2_", "m6_", "j1_", "s11_")


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        if name.startswith(SKIP_PREFIXES) or (args and not any(a in name for a in args)):
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        found = [m for m in MARKERS if re.search(rf"\b{m}\b", plan)]
        pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
        schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
        print(f"{name:30s} exchanges={plan.count('Exchange'):2d} {found}")
        for p, s in zip(pushed, schemas):
            print(f"    pushed=[{p[:100]}] read={s[:100]}")


if __name__ == "__main__":
    main()
