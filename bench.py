"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "cov_contig_stats", "cov_histogram", "cov_median_mad", "cov_callable_states", "cov_callable_intervals", "read_metrics", "genotype_likelihood", "site_reconcile", "base_tally_consensus",
    "consensus_weighted", "marker_consensus", "percentile_in_group", "full_outer_concordance", "census_conditional_distinct", "membership_union", "best_by_tuple", "interval_merge", "range_annotate", "asof_interpolate",
    "ibs_window", "dup_mark", "tree_closure", "tree_rollup", "tree_score", "pairwise_distance", "population_posterior", "fst_topk", "pca_project", "grouping_sets", "gvcf_target_bases", "str_haploid_call",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from helixframe import registry

    found = registry.queries()
    times = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        times[name] = round(statistics.median(each[1:] or each), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
