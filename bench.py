"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names instead of the default list
"""

from __future__ import annotations

import json
import os
import sys
import time

from clearfold.checks import all_checks
from clearfold.session import local_session, shared_dir

HEADLINE = [
    "vote_consensus_events",
    "vote_consensus_lineitem_gated",
    "vote_consensus_all_votes",
    "corpus_build",
    "e1_topk_per_post",
    "b3_label_from_text",
    "d6_numeric_profile",
    "g3_start_sample",
    "g6_split_roles",
    "e2_kfold_assignment",
    "e3_budget_prune",
    "e4_running_best",
    "j7_signal_features",
    "j2_extract_batch",
    "c9_cache_split",
    "k2_train_vocabulary",
    "k4_impute_scale",
    "d10_per_class_metrics",
    "d12_cost_by_model",
    "k5_elastic_net_fit",
    "k7_nested_cross_validation",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    shared_dir(spark)
    checks = all_checks()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM workers
    seconds = {}
    for name in names:
        started = time.perf_counter()
        checks[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
