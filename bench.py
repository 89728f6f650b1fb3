"""Benchmark the headline queries.

Runs each on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...,
"more_value": N, "more_queries": {...}}

Every query is fully executed with the ``noop`` sink (no collect), after one
warm-up run of a trivial job so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkeda.plans import catalog  # noqa: E402
from sparkeda.session import get_spark  # noqa: E402

HEADLINE = [
    # Q1 set
    "q1_filter_project", "q2_join_inner_left", "q3_join_anti", "q5_range_join", "q6_group_having", "q7_rollup",
    "q8_window_top_per_group", "q9_window_running", "q10_topk", "q11_set_ops", "q12_cte_correlated",
    "q13_functions", "q14_json_field",
    # profiles
    "a1_describe", "a3_column_profile", "a6_histogram", "a7_value_counts", "a8_correlation", "a11_group_mean",
    # cleaning / text
    "t6_clean_records", "t9_text_stats", "n3_zscore", "h8_emails_documents",
    # pages
    "h0_parse_pages", "h1_headings", "h2_paragraphs", "h3_visible_text", "h4_links", "g1_link_edges",
    # nested
    "j1_records_at_path",
    # learning
    "m10_classification_metrics", "m12_compare_models", "m17_kmeans",
]
# Built since BASELINE was measured: timed as well, apart from the headline total, which stays comparable.
MORE = [
    # many models, order and dictionaries, chosen kinds, repeated items, graphs, whole profiles
    "m20_elbow", "m18_silhouette_planted", "m6_stratified_exact", "m4_one_hot_vectors", "q9_running_chunks", "h7_everything_customers",
    "h14_repeated_items_customers", "h15_page_summary_customers", "g2_reachable_customers", "g3_page_chain_long_customers",
    "a9_eda_sections", "a12_quality_customers", "s11_bad_payloads", "u1_pipeline_stages", "u3_pipeline",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    catalog.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE + MORE:
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    head, more = ({n: t for n, t in times.items() if n in names} for names in (HEADLINE, MORE))
    out = {"metric": "total_query_seconds", "value": round(sum(head.values()), 3), "unit": "sec", "queries": head,
           "sf": float(m.group(1)) if m else sf_dir, "more_value": round(sum(more.values()), 3), "more_queries": more}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
