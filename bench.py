"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "rule_findings",
    "check_summary",
    "glob_classify",
    "proven_dependencies",
    "project_edges",
    "node_metrics",
    "graph_candidates",
    "pagerank_six_rounds",
    "confusion_grouping_sets",
    "unified_metrics",
    "grouped_split",
    "split_leakage",
    "latency_statistics",
    "event_replay",
    "provenance_top_k",
    "arity_join",
    "flow_lattice",
    "secret_scan",
    "evidence_alignment",
    "ridge_fit",
)


def main() -> None:
    from plumbline.plans import all_queries
    from plumbline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["rule_findings"](spark, sf_dir).count()  # warms the JVM up
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
