"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run once to warm up code generation and then timed; every row is produced and
counted, nothing is cached between runs. ``rows_per_sec`` divides the rows of ``lineitem`` by the seconds.
"""

from __future__ import annotations

import json
import os
import time

from plantscope import plans
from plantscope.session import local_session

HEADLINE = (
    "spc_individuals_points",
    "spc_summary",
    "spc_run_rules",
    "spc_ewma_points",
    "spc_cusum_points",
    "spc_xbar_r_points",
    "spc_iqr_outliers",
    "anomaly_auto_control_events",
    "anomaly_exceedance_runs_above",
    "profile_columns",
    "role_detection",
    "quality_outliers",
    "quality_duplicate_rows",
    "distribution_ranked_closed_forms",
    "distribution_ks",
    "gauge_rr",
    "feature_table",
    "split_walk_forward_folds",
    "model_linear_coefficients",
    "validation_folds",
    "residual_stats",
    "anova_coefficients",
    "contribution_linear",
    "forecast_fold_metrics",
    "forecast_ar1",
    "risk_spec",
    "risk_empirical_cdf",
    "deidentify_masked_table",
    "quality_report",
    "sensitivity_permutation",
    "forecast_block_permutation",
    "route_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.all_queries()
    seconds = {}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {name: round(rows / s) for name, s in seconds.items()},
                "rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
