"""Time the headline queries: warm-up, then the median of three runs each. One JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.registry import QUERIES  # noqa: E402
from checks.scratch import ensure_scratch  # noqa: E402

HEADLINE = [
    "crop_convert_monthly",
    "clip_seasonal",
    "download_plan",
    "catalog_build",
    "agg_monthly_mean",
    "agg_seasonal_sum",
    "agg_annual_max",
    "agg_monthly_std",
    "agg_monthly_median",
    "median_by_ranges",
    "crop_bbox",
    "crop_status",
    "point_in_polygon",
    "clip_mask",
    "clip_buffer",
    "clip_status",
    "convert_units",
    "convert_lookup",
    "cf_decode_time",
    "coord_resolve_crop",
    "catalog_dedup",
    "catalog_nested",
    "merge_nodes_cmip6",
    "mirror_rank",
    "verify_checksum",
    "vocab_validate",
    "era5_expand",
    "prefix_first_key",
    "dem_resolve_usgs",
    "availability_semi",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ensure_scratch(spark).sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, median of three warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
