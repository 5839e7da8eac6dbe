"""Time all queries and print one JSON line; its value is the total of the headline queries.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from harvestlens.plans.catalog import QUERIES
from harvestlens.session import local_session

HEADLINE = [
    "impacts_all_periods",
    "baseline_statistics",
    "ensemble_statistics",
    "boxplot_summary",
    "region_weighted_mean",
    "adaptation_effectiveness",
    "adaptation_rank",
    "standardize_wide",
    "standardize_long",
    "climate_quality",
    "growing_season",
    "centered_mean",
    "nearest_cell",
    "bilinear",
    "point_in_polygon",
    "status_latest",
    "work_split",
    "one_hot",
    "regression_metrics",
    "simulation_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", folder=tempfile.mkdtemp(prefix="bench-"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's threads
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    timings = {}
    for name in [*HEADLINE, *(n for n in QUERIES if n not in HEADLINE)]:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
