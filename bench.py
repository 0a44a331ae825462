"""Time the headline queries and print one JSON line.

Each query is run twice into a no-op sink; the faster run counts, so that class
loading and code generation of the first run are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidepanel.queries import registry
from tidepanel.session import local_session

HEADLINE = (
    "series_load",
    "resample_freq",
    "outer_align",
    "asfreq_grid_panels",
    "chrono_split",
    "interp_linear",
    "cap_outliers",
    "spline_impute",
    "spline_cubic",
    "deflate",
    "zscore_train_fit",
    "pct_change",
    "rolling_detrend_diff",
    "df_lag0",
    "adf_autolag",
    "choose_transform",
    "choose_transform_autolag",
    "apply_transform",
    "extract_minimal",
    "features_lagged_rolling",
    "features_order",
    "features_array_rolling",
    "features_change_quantiles",
    "features_partial_autocorrelation",
    "features_permutation_entropy_rolling",
    "features_fourier_rolling",
    "order_statistics_long",
    "add_one_scores",
    "drop_one_scores",
    "threshold_sweep",
    "param_trials",
    "search_summary",
    "prepare_panel",
    "engineer_panel",
    "engineer_gaps",
    "add_one_linear",
    "greedy_add",
    "threshold_sweep_scored",
    "extract_comprehensive",
    "gbt_score",
    "flagship",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    registered = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
