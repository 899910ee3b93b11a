"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from riverline.catalog import QUERIES
from riverline.session import local

HEADLINE = [
    "flagship_volumes", "line_curvature", "line_overall_bottom", "line_resample_floor", "line_curvature_runs", "join_water_level", "join_station_reach", "join_point_in_polygon", "join_bilinear",
    "section_area_a", "section_area_b", "volumes_depth_bands", "volumes_by_chunk", "screening_stretches", "raster_despike", "rules_governing", "search_never_rising", "search_cascade",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"), "riverline-bench")
    QUERIES["flagship_volumes"](spark, sf).write.format("noop").mode("overwrite").save()  # compiles and warms
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
