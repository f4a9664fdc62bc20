"""Time the headline queries: python bench.py  (BENCH_SF_DIR, BENCH_CPUS)."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.plans import QUERIES  # noqa: E402

HEADLINE = [
    "d01_entity_mean_max", "d02_source_structure", "d04_numeric_audit", "d06_exact_quantiles", "d07_date_audit", "d09_latest_date_ties",
    "d12_pair_diagnostics", "d24_coverage_rows", "d41_feature_audit", "c04_grouped_dates", "c08_combined_history", "c15_summary_vs_detail",
    "i02_nested_splits", "i05_train_caps", "i11_linear_matrix", "f01_global_prefix", "m06_model_metrics", "l03_subgroup_metrics",
    "l06_reassessment", "l07_migration", "l08_approval_curve", "l09_approval_switches", "l10_risk_budget_curve", "l12_scenario_values",
    "k03_logistic_fit", "k05_cross_fit_isotonic", "k07_paired_bootstrap", "k15_tie_preserving_bins", "a18_identifier_mining",
    "m01_logistic_candidates", "m02_boosted_tree_candidates", "m03_perceptron_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.extraJavaOptions", "--add-modules=jdk.incubator.vector")  # vectorised BLAS of Spark ML
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the executor threads
    times = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


main()
